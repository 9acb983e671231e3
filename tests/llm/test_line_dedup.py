import random

from pixelsift.llm import line_dedup


def brute(texts, least):
    """A line goes if a run of at least ``least`` words around it occurred before."""
    lines = []
    for i, t in sorted((x for x in texts if x[1] is not None), key=lambda x: x[0]):
        for pos, raw in enumerate(t.split("\n")):
            words = raw.split()
            if words:
                lines.append((i, pos, " ".join(words), len(words)))
    first, gone = {}, set()
    for a in range(len(lines)):
        n = 0
        for z in range(a, len(lines)):
            if lines[z][0] != lines[a][0]:
                break
            n += lines[z][3]
            if n >= least:
                key = tuple(x[2] for x in lines[a : z + 1])
                if first.setdefault(key, (lines[a][0], lines[a][1])) != (lines[a][0], lines[a][1]):
                    gone |= {(x[0], p) for x in lines[a : z + 1] for p in range(x[1], x[1] + 1)}
                    lo, hi = lines[a][1], lines[z][1]
                    gone |= {(lines[a][0], p) for p in range(lo, hi + 1)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts}


def test_against_brute_force(docs):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    texts = []
    for i in range(60):
        texts.append((i, "\n".join(rng.choice(["", " "]) if rng.random() < 0.1 else rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 14)))))
    df = docs(*texts, extra=("runs", "a", "_id"))
    out = line_dedup.delete_repeated_runs(df, least=12)
    assert out.columns == df.columns
    want = brute(texts, 12)
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_odd_documents(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [(1, None), (2, ""), (3, "\n\n"), (4, passage), (5, "mine\n" + passage + "\nyours"), (6, passage.replace(" ", "  ")), (7, "short\nshort"), (None, "null id\n" + passage)]
    out = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs(*texts)).collect()}
    assert out == {1: None, 2: "", 3: "\n\n", 4: "", 5: "mine\nyours", 6: "", 7: "short\nshort", None: "null id\n" + passage}
    assert line_dedup.delete_repeated_runs(docs((1, "x")).limit(0)).count() == 0


def test_repeated_rows_agree(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = line_dedup.delete_repeated_runs(docs((1, passage), (1, passage), (2, passage + "\nend"))).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, passage), (1, passage), (2, "end")]


def test_junk_lines(docs):
    text = "\n".join(["ab cd"] * 200)
    (row,) = line_dedup.delete_repeated_runs(docs((1, text))).collect()
    assert row.text == "ab cd"  # a run may overlap its earlier occurrence


def test_a_very_long_text_and_emptied_documents(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"{i} " + " ".join(f"v{(i * k) % 97}" for k in range(9)) for i in range(20_000))
    df = docs((1, passage), (2, passage), (3, long), (4, long + "\n" + passage), (5, None), (6, " \n"))
    left = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(df).collect()}
    assert left == {1: passage, 2: "", 3: long, 4: "", 5: None, 6: " \n"}
    assert {r.doc_id for r in line_dedup.delete_repeated_runs(df, drop_emptied=True).collect()} == {1, 3, 5, 6}
