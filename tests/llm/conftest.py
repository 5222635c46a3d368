import pytest

WORDS = ["river", "stone", "light", "garden", "winter", "table", "music", "paper", "cloud", "metal", "forest", "silver", "market", "bridge", "letter", "window", "summer", "engine", "copper", "valley"]


def prose(seed: int, n: int) -> str:
    """n words of invented prose in sentences and lines, the same for the same seed."""
    state, out = seed * 2654435761 % 2**32 + 1, []
    for k in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        word = WORDS[(state >> 8) % len(WORDS)] + "abcdefghij"[(state >> 20) % 10] + "klmnopqrst"[(state >> 26) % 10]
        out.append(word + (".\n" if k % 12 == 11 else "," if k % 7 == 6 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and extra columns; and their folder."""
    rows = [
        (1, prose(1, 80), "en", "web", 5), (2, prose(2, 80), "en", "web", 5), (2, prose(2, 80), "en", "web", 5), (3, prose(2, 80), "en", "books", 5),
        (4, None, "en", "web", 5), (5, "", "de", "web", 5), (None, prose(6, 60), "en", "web", 5), (7, prose(7, 60), None, None, None),
        (8, " \n\t\n ", "en", "web", 5), (9, "one two three", "fr", "web", 5), (10, prose(10, 30_000), "en", "web", 5), (11, "word " * 5_000, "en", "web", 5),
        (12, "\x00\x01 bad   bytes é 漢字 🙂 " * 5, "en", "web", 5), (None, None, None, None, None), (2, prose(20, 50), "en", "web", 5),
        (13, prose(13, 40) + "\n" + prose(14, 60), "en", "web", 5), (14, prose(15, 40) + "\n" + prose(14, 60), "en", "news", 5), (15, "x" * 100_000, "en", "web", 5),
    ]
    df = spark.createDataFrame([(*r, "n", 1, "t", "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, n int, target string, key string, size double")
    path = str(tmp_path_factory.mktemp("odd"))
    df.coalesce(2).write.parquet(f"{path}/documents.parquet")
    items = [(0, prose(14, 60)), (1, "river stone"), (2, None), (None, prose(3, 30)), (3, ""), (4, prose(99, 40))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 1), (4, 1, 1), (7, None, None), (None, 1, 1), (13, 1, 0), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def duck():
    """SQL over a folder's tables, as sorted rows."""
    import duckdb

    def run(sql: str, path: str):
        con = duckdb.connect()
        for name in ("documents", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        return names, got.fetchall()

    return run


def same(frame, got) -> None:
    """The frame's rows are the SQL's rows, columns by name."""
    names, rows = got
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    neat = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted((tuple(neat(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(neat(r[names.index(c)]) for c in order) for r in rows), key=repr)
    assert ours == theirs
