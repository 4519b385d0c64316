from litscreen.llm.url_filter import judge_urls


def verdicts(spark, urls):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule int")
    return [tuple(r)[1:] for r in judge_urls(pages).orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    got = verdicts(
        spark,
        [
            "http://WWW.Example.NET/en/1?x#y",
            "https://example.net/de/",
            "https://example.net",
            "a://b.example.com/de/?q",
            "a://notexample.com/de/",
            "x://a.org/fr/u",
            "no scheme",
            None,
            "",
            "http://h?://z/",
            "http://a.net/://b",
            "http://É.com/Ä\n/b",
        ],
    )
    assert got == [
        ("www.example.net", "/en/1", "example.net/en/", "allow", None),
        ("example.net", "/de/", "net/", "block", None),
        ("example.net", "", None, "allow", 0),
        ("b.example.com", "/de/", "example.com/de/", "block", None),
        ("notexample.com", "/de/", None, "allow", 0),
        ("a.org", "/fr/u", "org/fr/", "allow", None),
        ("", "", None, "allow", 0),
        ("", "", None, "allow", 0),
        ("", "", None, "allow", 0),
        ("h", "", None, "allow", 0),
        ("a.net", "/://b", "net/", "block", None),
        ("É.com", "/Ä\n/b", None, "allow", 0),
    ]


def test_terms_need_boundaries_and_two_soft_hits(spark):
    got = verdicts(
        spark,
        ["x://casino.com/", "x://casinos.com/", "x://a.com/FREE-pills", "x://a.com/free-free", "x://freebets.com", "x://a.com/free_win"],
    )
    assert [r[3:] for r in got] == [("block", 2), ("allow", 0), ("block", 2), ("allow", 1), ("allow", 0), ("block", 2)]


def test_empty_table(spark):
    assert verdicts(spark, []) == []
