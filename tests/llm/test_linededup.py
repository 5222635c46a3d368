"""Line dedup against brute force over all runs of enough words, not only the shortest."""

import numpy as np

from weft.llm import linededup


def words(tag: str, n: int) -> str:
    return " ".join(f"{tag}{k}" for k in range(n))


def brute(docs: list[tuple[int, str]]) -> dict[int, str]:
    """Every run of consecutive lines with MIN_WORDS words or more loses its lines if it occurs earlier by (doc_id, line)."""
    seen, gone, texts = set(), set(), {d: t.split("\n") for d, t in docs}
    for d in sorted(texts):
        full = [k for k, line in enumerate(texts[d]) if line.split()]
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(texts[d][k].strip() for k in full[a : b + 1])
                if sum(len(x.split()) for x in run) < linededup.MIN_WORDS:
                    continue
                if run in seen:
                    gone.update((d, k) for k in full[a : b + 1])
                seen.add(run)
    return {d: "\n".join(x for k, x in enumerate(lines) if (d, k) not in gone) for d, lines in texts.items()}


def left(spark, docs) -> dict[int, str]:
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame).collect()}


def test_the_last_lines_of_a_repeat_go_too(spark):
    copy = "\n".join(words(t, n) for t, n in (("a", 40), ("b", 40), ("c", 10)))
    passage = words("p", 35) + "\n" + words("q", 25)
    docs = [(1, copy), (2, copy), (3, passage + "\n" + words("x", 50)), (4, words("y", 50) + "\n" + passage + "\n" + words("z", 50))]
    got = left(spark, docs)
    assert got[2] == "" and got[4] == words("y", 50) + "\n" + words("z", 50)
    assert got == brute(docs)


def test_against_all_runs(spark):
    rng = np.random.default_rng(7)
    pool = [words(f"l{k}w", int(n)) for k, n in enumerate(rng.integers(1, 45, 14))] + ["", " \t"]
    docs = [(d, "\n".join(pool[k] for k in (rng.integers(0, 4) + np.arange(rng.integers(1, 12)) * rng.integers(1, 3)) % len(pool))) for d in range(60)]
    assert left(spark, docs) == brute(docs)
