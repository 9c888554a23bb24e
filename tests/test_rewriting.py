from corpusloom.operators import rewriting


def test_rules(spark):
    css = """a{b:url( "img/a b.png" )} c{b:url('https://cdn.example/x.png?v=1')} d{b:url(data:image/png,x)} e{b:url(#m)} f{b:url(//cdn.example/y.png)}
g{b:url(https://www.google-analytics.com/t.gif)} h{b:url(/gone.html)} é😀{b:url(../up.png)}"""
    styles = [(1, "site/css/s.css", None, css), (2, "_external/cdn.example/t.css", "https://cdn.example/css/t.css", "a{b:url(../y.png)} c{b:url(z.png)}"), (3, "site/p.html", None, "no url"), (4, "site/p.html", None, None)]
    styles = spark.createDataFrame(styles, "id int, page string, source string, text string")
    copies = spark.createDataFrame([("https://cdn.example/x.png", "_fonts/x.png"), ("https://cdn.example/y.png", "site/y.png")], "key string, kept_as string")
    ignored = spark.createDataFrame([("site/gone.html",), ("site/gone.html",)], "path string")
    urls = rewriting.decided(rewriting.style_urls(styles), copies, "site", ignored)
    got = {r.id: r.text for r in rewriting.rewritten(styles, urls).collect()}
    assert got == {
        1: """a{b:url("/css/img/a%20b.png")} c{b:url("/_external/_fonts/x.png")} d{b:url(data:image/png,x)} e{b:url(#m)} f{b:url("/y.png")}
g{b:url('')} h{b:url('')} é😀{b:url("/up.png")}""",
        2: """a{b:url("/y.png")} c{b:url('')}""",
        3: "no url",
        4: None,
    }
    assert {(r.raw, r.outcome) for r in urls.collect() if r.id == 1} == {("img/a b.png", "local"), ("https://cdn.example/x.png?v=1", "copied"), ("//cdn.example/y.png", "copied"), ("https://www.google-analytics.com/t.gif", "tracker"), ("/gone.html", "ignored"), ("../up.png", "local")}
    assert rewriting.rewritten(styles.limit(0), urls).count() == 0
