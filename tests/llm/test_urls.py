"""URL rules and the model's verdicts."""

from splicework.llm import urls


def judged(spark, addresses, rules=urls.RULES):
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(addresses)], "page_id long, url string, score string, slots string")
    return [tuple(r)[1:] for r in sorted(urls.judged(df, rules).select("page_id", "host", "path", "rule", "verdict", "slots").collect())]


def test_parse_and_rules(spark):
    got = judged(spark, [
        "http://WWW.Example.COM/en/1?x=/fr/", "https://a.www.example.com/en/", "https://shop.example.com/en/2", "http://example.com/fr/", "http://notexample.com/en/",
        "http://b.net/es/9", "http://b.net/ES/9", "http://b.net", None, "no scheme", "http://É.com/#a/b", "http://a.com?q=http://b.net/es/", "",
    ])
    assert [g[:3] for g in got] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.www.example.com", "/en/", "www.example.com/en/"), ("shop.example.com", "/en/2", "example.com/en/"), ("example.com", "/fr/", "com/"),
        ("notexample.com", "/en/", "com/"), ("b.net", "/es/9", "net/es/"), ("b.net", "/ES/9", None), ("b.net", "", None), ("", "", None), ("", "", None), ("É.com", "/", "com/"),
        ("a.com", "", None), ("", "", None),
    ]
    assert [g[3] for g in got[:6]] == ["allow", "allow", "block", "allow", "allow", "block"] and got[8][3] == got[9][3] == got[12][3] == "block"
    assert all(g[4] == "mine" for g in got)


def test_model_tells_kinds_apart(spark):
    allowed = [f"http://garden{i % 17}.com/flowers/rose{i}" for i in range(300)]
    blocked = [f"http://zzqx{i % 17}.net/es/xqzz{i}" for i in range(300)]
    asked = [f"http://garden{i}.org/flowers/tulip" for i in range(20)] + [f"http://zzqx{i}.org/qz/xqzz" for i in range(20)] + ["http://" + "a" * 50000 + ".org/"]
    got = judged(spark, allowed + blocked + asked)[600:]
    assert [g[3] for g in got[:40]] == ["allow"] * 20 + ["block"] * 20 and got[40][3] in ("allow", "block")


def test_one_class_or_none(spark):
    assert [g[3] for g in judged(spark, ["http://a.com/", "http://b.org/x"])] == ["allow", "allow"]
    assert [g[3] for g in judged(spark, [*[f"http://b{i}.net/es/" for i in range(40)], "http://b.org/x"])][40] == "block"
    assert [g[3] for g in judged(spark, ["http://b.org/x"], ())] == ["allow"]
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(df).count() == 0
