from collections import Counter, defaultdict

from pyspark.sql import functions as F

from voxelith.llm import linededup


def brute(rows, ratio, least):
    total, n = Counter(), defaultdict(Counter)
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, t, s in rows:
        total[s] += 1
        n[s].update({bare(x) for x in (t or "").split("\n")} - {""})
    out = []
    for d, t, s in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (n[s][bare(x)] >= least and n[s][bare(x)] > ratio * total[s])]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(df, ratio=linededup.RATIO, least=linededup.MIN_PAGES):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = linededup.line_dedup(df, ratio=ratio, min_pages=least).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == brute(rows, ratio, least)
    return sum(r["n_dropped"] for r in got)


def test_against_brute_force(docs, odd, empty):
    assert check(docs) > 0 and check(docs, 0.08, 2) > 0
    check(odd, 0.3, 1)
    check(empty, 0.08, 2)


def test_hosts_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    df = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), linededup.url_host(pages["url"]).alias("source"))
    assert df.select("source").distinct().count() > 5 and df.where("source is null").count() == 0
    check(df)
    tags = df.withColumn("text", F.regexp_replace("text", "><", ">\n<"))
    assert check(tags) > 0


def test_long_texts(spark):
    lines = [f"line {i}" for i in range(400_000)]
    rows = [(1, "\n".join(lines), "s"), (2, "\n".join(lines[:3]), "s"), (3, "line 1\nx", "s"), (4, "y" * 5_000_000, "s")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_host_and_clashing_columns(spark):
    rows = [(i, "http://u:p@Ex.org:80/a", "menu\nown %d" % i, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string, n_lines string")
    out = linededup.line_dedup(df, linededup.url_host(df["url"]))
    assert out.columns == ["doc_id", "url", "text", "n_lines", "n_dropped"]
    assert {r["text"] for r in out.collect()} == {"own %d" % i for i in range(12)}
    assert df.select(linededup.url_host(df["url"])).first()[0] == "ex.org"


def test_small_hosts_lose_their_boilerplate(spark):
    """With the least floor and the ratio as they are: 3 of 3 pages, 4 of 40; not 2 of 2, 3 of 40."""
    rows = [(i, f"menu\nown {i}", "a") for i in range(3)] + [(10 + i, f"menu\nown {10 + i}", "b") for i in range(2)]
    rows += [(100 + i, "\n".join(["menu"] * (i < 4) + ["bar"] * (i < 3) + [f"own {100 + i}"]), "c") for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [out[i] for i in (0, 2, 10, 100, 103)] == ["own 0", "own 2", "menu\nown 10", "bar\nown 100", "own 103"]


def test_carriage_returns_and_tabs_at_the_ends(spark):
    rows = [(i, f"{'menu' + end}\nown {i}\n\t\r", "a") for i, end in enumerate(["", "\r", "\t", " \r", "\x0b\x0c"])]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["text"] for r in out} == {f"own {i}\n\t\r" for i in range(5)}
