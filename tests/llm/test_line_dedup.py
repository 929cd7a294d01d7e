import random
import re

from corpus_pipeline import line_dedup_stage
from skiplight.llm.line_dedup import dedup_lines, line_units, marks, sentence_units


def brute(rows):
    """Texts after deleting every maximal run that holds a window and that an earlier equal one precedes: each pair of
    equal windows is extended line by line to both sides."""
    texts = [(i, (text or "").split("\n")) for i, text in sorted(rows, key=lambda r: r[0])]
    held = [(i, [n for n, x in enumerate(lines) if x.strip()], [x.strip() for x in lines if x.strip()]) for i, lines in texts]
    seen, out = {}, {}
    for d, (i, at, bare) in enumerate(held):
        gone = set()
        for a in range(len(bare)):
            for b in range(a, len(bare)):
                if b - a >= 2 or sum(len(x.split()) for x in bare[a : b + 1]) >= 50:
                    run = tuple(bare[a : b + 1])
                    for e, q in seen.setdefault(run, []):
                        other, x, y = held[e][2], 0, b - a
                        while min(a, q) + x > 0 and bare[a + x - 1] == other[q + x - 1]:
                            x -= 1
                        while a + y + 1 < len(bare) and q + y + 1 < len(other) and bare[a + y + 1] == other[q + y + 1]:
                            y += 1
                        gone |= set(range(at[a + x], at[a + y] + 1))
                    seen[run].append((d, a))
                    break
        out[i] = "\n".join(x for n, x in enumerate(texts[d][1]) if n not in gone)
    return out


def test_equals_brute_force(docs_of):
    rng = random.Random(5)
    lines = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([1, 3, 60]))) for _ in range(30)] + ["", "  ", "\t tabbed \r", "grün"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    got = {r["doc_id"]: r for r in dedup_lines(docs_of(rows)).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute(rows)
    assert sum(r["n_removed_lines"] for r in got.values()) > 50


def test_a_run_extends_both_ways_whichever_copy_it_comes_from(docs_of):
    a, b = "p\nq\nr\ns\nt\nu".split("\n"), "x\ny".split("\n")
    rows = [(1, "\n".join(a[:4])), (2, "\n".join(a[2:])), (3, "\n".join(b[:1] + a + b[1:]))]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: "p\nq\nr\ns", 2: "r\ns\nt\nu", 3: "x\ny"}


def test_defined_cases(docs_of):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(5, None), (6, ""), (7, "\n\n"), (1, passage), (2, "before\n" + passage + "\nafter"), (3, "a\nb\nc\na\nb\nc"), (4, "l\nl\nl\nl\nl"), (9, "one line"), (10, "one line"), (None, "k1\nk2\nk3"), (11, "k1\n\nk2\n \nk3\nend"), (12, "same\nrow\nhere"), (12, "same\nrow\nhere"), (13, passage + "\n" + "z " * 100_000)]
    got = dedup_lines(docs_of(rows, extra=["runs", "k", "h", "N_Lines", "a.b", "back`tick", "c0"])).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines_"], r["n_removed_lines"]))
    assert by[5] == [(None, 0, 0)] and by[6] == [("", 0, 0)] and by[7] == [("\n\n", 0, 0)]
    assert by[1] == [(passage, 1, 0)] and by[2] == [("before\nafter", 3, 1)]
    assert by[3] == [("a\nb\nc", 6, 3)] and by[4] == [("l", 5, 4)]
    assert by[9] == by[10] == [("one line", 1, 0)]  # shorter than any window
    assert by[None] == [("k1\nk2\nk3", 3, 0)] and by[11] == [("end", 4, 3)]
    assert by[12] == [("same\nrow\nhere", 3, 0)] * 2 and by[13][0][1:] == (2, 1)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "runs", "k", "h", "N_Lines", "a.b", "back`tick", "c0", "n_lines_", "n_removed_lines"}
    assert all(r["N_Lines"] == r["a.b"] == r["c0"] == "x" for r in got)
    assert dedup_lines(docs_of([])).collect() == []


def test_windows_are_winnowed():
    text = "\n".join(f"line {i}" for i in range(200)).encode()
    found = marks(text, 3, 50, False)
    assert sum(map(len, found.values())) == 198 and len(found) < 130  # about two in four lines are selected
    assert marks(b"a\nb", 3, 50, False) == {} and len(marks(b" ".join([b"x"] * 50), 3, 50, False)) == 1


def test_fingerprints_of_a_run_meet(monkeypatch, docs_of):
    """Each copy of a run selects the same line in it; without the selected fingerprints nothing is found."""
    run = [f"shared {i}" for i in range(7)]
    a, b = marks("\n".join(["x", "y", *run]).encode(), 3, 50, False), marks("\n".join([*run, "z"]).encode(), 3, 50, False)
    assert {m for _, m in a} & {m for _, m in b}
    rows = [(1, "\n".join(run)), (2, "\n".join(["x", *run]))]
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(rows)).collect()} == {1: rows[0][1], 2: "x"}


def test_short_lines_after_a_long_one_go_with_its_run(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\n\nb\nc\nd"), (2, f"a\n{long}\n\nb\nc\nd"), (3, f"x\n{long}\n\nb\ny"), (4, f"{long}\nb"), (5, f"b\n{long}")]
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 5), 3: ("x\ny", 2), 4: ("", 2), 5: ("b", 1)}


def test_the_pipeline_deletes_whole_runs(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{long}\nb"), (2, f"x\n{long}\nb\ny"), (3, f"{long}\nb")]
    assert {r["doc_id"]: r["text"] for r in line_dedup_stage(spark, docs_of(rows), "").collect()} == {1: rows[0][1], 2: "x\ny"}


def brute_sentences(texts):
    """(id, line, sentence) of all sentences in maximal runs of 50 words that an earlier equal one precedes."""
    flat = [(i, [(n, m, x) for n, line in enumerate(t.split("\n")) for m, x in enumerate(line.split(". "))]) for i, t in sorted(texts)]
    flat = [(i, [(n, m, x.rstrip(".")) for n, m, x in units]) for i, units in flat]
    gone = set()
    for d, (i, u) in enumerate(flat):
        for e in range(d):
            v = flat[e][1]
            for a in range(len(u)):
                for q in range(len(v)):
                    y = 0
                    while a + y < len(u) and q + y < len(v) and u[a + y][2] == v[q + y][2]:
                        y += 1
                    if sum(len(x.split()) for _, _, x in u[a : a + y]) >= 50:
                        gone |= {(i, n, m) for n, m, _ in u[a : a + y]}
    return gone


def test_runs_of_sentences_equal_brute_force():
    """Sentences that are all different inside a text, dealt over lines anew in each text."""
    rng = random.Random(3)
    pool = [" ".join(f"s{i}w{j}" for j in range(rng.choice([3, 12, 30, 60]))) for i in range(40)]
    texts = []
    for i in range(40):
        a = rng.randrange(30)
        own = [f"own {i}", *pool[a : a + rng.randint(1, 9)], f"end {i}", *pool[: rng.randint(0, min(a, 5))]]
        texts.append((i, "".join(x + rng.choice([". ", ". ", ".\n"]) for x in own).strip()))
    want, seen, got = brute_sentences(texts), set(), set()
    for i, t in texts:
        data = t.encode()
        spans = [s for x in marks(data, 10_000, 50, True).values() for s in x]
        places = {begin: (i, t[:begin].count("\n"), m) for line in line_units(data) for m, (_, begin, _) in enumerate(sentence_units(data, [line]))}
        got |= {places[n] for content, a, b in spans if content is None or content in seen for n in places if a <= n < b}
        seen |= {content for content, _, _ in spans}
    assert got == want and len(got) > 50


def test_passages_inside_lines(docs_of):
    passage = ". ".join(" ".join(f"p{i}q{j}" for j in range(20)) for i in range(3)) + "."
    rows = [(1, f"One starts here.  {passage} It ends."), (2, f"Two starts.\tAnd goes on. {passage}  It stops so.\nlast"), (3, passage.replace(". ", ".\n\n"))]
    rows += [(4, f"Four. {passage[:-40]}"), (5, f"begins within {passage}")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"], r["n_removed_chars"]) for r in dedup_lines(docs_of(rows), sentences=True).collect()}
    assert got[1] == (rows[0][1], 1, 0, 0) and got[2] == ("Two starts.\tAnd goes on. It stops so.\nlast", 2, 0, len(passage) + 2) and got[3] == ("", 3, 3, len(rows[2][1]))
    assert got[4] == (rows[3][1], 1, 0, 0) and got[5] == (rows[4][1], 1, 0, 0)  # their whole sentences hold 40 words
    out = {r["doc_id"]: r for r in line_dedup_stage(docs_of([]).sparkSession, docs_of(rows), "").collect()}
    assert out[2]["text"] == got[2][0] and out[2]["n_chars"] == len(got[2][0]) and 3 not in out
