"""Declared shapes of captured data; readers never infer."""

INVENTORY = "path string, bytes bigint, sha256 string"
REFERENCE = "source string, raw string, kind string, resolved string"
FINDING = "file string, kind string, url string, complete boolean, line int, column int"
CREDENTIAL = "kind string, line int, column int, fingerprint string"
HISTORY = "stage string, event string, at timestamp, signature string"
REPAIR = "finding string, strategy string, signature string, action string, passed boolean, at timestamp"
RECT = "struct<x double, y double, width double, height double>"
GEOMETRY = f"key string, rect {RECT}, style map<string,string>"
RULE = "ord int, match string, prefix string, methods array<string>, status int, json string"
