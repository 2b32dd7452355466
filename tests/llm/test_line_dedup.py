from collections import Counter

from quillmark.llm import line_dedup as L

ROWS = [(i, "a", f"head\nbody {i}\n\nfoot\nfoot") for i in range(20)] + [(100 + i, "b", f"body {i}\nhead") for i in range(3)] + [
    (200, None, "head"), (201, "a", None), (202, "a", ""), (203, None, "x\n\ny"), (204, "a", "head"), (205, "a", "head\r\nfoot "), (206, "b", "word " * 50_000),
]


def brute(rows, ratio, least):
    totals, counts = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        counts.update((s, x) for x in set((t or "").split("\n")) if t is not None and x.strip(" \t\n\v\f\r"))
    gone = {k for k, n in counts.items() if n >= least and n / totals[k[0]] > ratio}
    out = []
    for i, s, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (s, x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force_both_ways(spark):
    docs = spark.createDataFrame(ROWS + ROWS[:2], "doc_id long, source string, text string")
    want = brute(ROWS + ROWS[:2], 0.5, 4)
    for most in (1000, 0):
        found = L.dedup_lines(docs, ratio=0.5, least_pages=4, broadcast_lines=most)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == want


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "x", 9)], "doc_id long, source string, text string, n_lines int")
    found = L.dedup_lines(docs)
    assert found.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"] and found.first().n_lines == 1
    for most in (10, 0):
        assert L.dedup_lines(docs.limit(0), broadcast_lines=most).count() == 0


def test_clashing_columns_come_back(spark):
    names = ["_gone", "_left", "_site", "_row", "_kept", "_drop", "row", "at", "line", "h1", "salt"]
    docs = spark.createDataFrame([(*r, *names, 7) for r in ROWS], f"doc_id long, source string, text string, {', '.join(f'{n} string' for n in names)}, N_LINES int")
    for most in (1000, 0):
        found = L.dedup_lines(docs, ratio=0.5, least_pages=4, broadcast_lines=most)
        assert found.columns == [*docs.columns, "n_dropped"]
        rows = found.collect()
        assert sorted(((r.doc_id, r.N_LINES, r.n_dropped, r.text) for r in rows), key=str) == brute(ROWS, 0.5, 4)
        assert all(r[n] == n for r in rows for n in names)
