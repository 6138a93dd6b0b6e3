import hashlib
import random
import re

import pytest
from corpus_cases import empty, frame, odd_rows, prose

from framewright.llm import op11_line_dedup as m

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected(rows, min_chars=10, min_documents=2):
    last = (True, 0)
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = key_of(line)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add((False, r[0]) if r[0] is not None else last)
    out = []
    for r in rows:
        me = (False, r[0]) if r[0] is not None else last
        lines = (r[1] or "").split("\n")
        kept = [
            x for x in lines
            if len(holders.get(key_of(x), ())) < min_documents or min(holders[key_of(x)]) == me
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((r[0], len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, m.line_digests(df).collect()), key=str)


def doc(i, text):
    return (i, text, "en", "a", 0)


def shared_lines(n, seed):
    """Texts of lines of a small pool, with other cases, blanks and marks around them."""
    rng = random.Random(seed)
    pool = [prose(i, rng.randrange(1, 5)) for i in range(60)]

    def line():
        some = rng.choice(pool)
        return rng.choice(["", " ", "\t\x0b"]) + rng.choice([some, some.upper(), some + "é"]) + rng.choice(["", "\r", " "])

    return [doc(i, "\n".join(line() for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def test_against_plain_python(spark):
    rows = shared_lines(120, 3) + odd_rows()
    assert found(m.drop_repeated_lines(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize(("chars", "documents"), [(1, 2), (10, 3), (14, 5)])
def test_other_limits(spark, chars, documents):
    rows = shared_lines(60, 4)
    got = m.drop_repeated_lines(frame(spark, rows), min_chars=chars, min_documents=documents)
    assert found(got) == expected(rows, chars, documents)


def test_limits_of_length_and_case(spark):
    rows = [
        doc(1, "ABCDEFGHIJ\nabcdefghi\nÀBCDEFGHIJ"),
        doc(2, "  abcdefghij\x0b\nabcdefghi\nàbcdefghij"),
        doc(3, " abcdefghij\nÀbcdefghij"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in m.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == {
        1: (rows[0][1], 0),
        # Nine characters are too few; other letters keep their case.
        2: ("abcdefghi\nàbcdefghij", 1),
        # A no-break space isn't stripped.
        3: (" abcdefghij", 1),
    }


def test_first_document_keeps_its_repeats(spark):
    rows = [doc(5, "one long line\none long line"), doc(3, "one long line\nx\none long line"), doc(None, "one long line")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in m.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == {5: ("", 2, 2), 3: (rows[1][1], 3, 0), None: ("", 1, 1)}


def test_hot_line_and_very_long_text(spark):
    long = "\n".join(f"line number {i}" for i in range(40_000))
    rows = [doc(i, f"a line that all of them hold\nown line of {i}") for i in range(1500)]
    rows += [doc(9_000, long), doc(9_001, long + "\nand an end")]
    got = {r["doc_id"]: r for r in m.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got[0]["n_dropped"] == 0 and got[7]["text"] == "own line of 7"
    assert got[9_001]["text"] == "and an end" and got[9_001]["n_dropped"] == 40_000
    assert got[9_000]["text"] == long


def test_nothing(spark):
    assert m.drop_repeated_lines(empty(spark)).collect() == []


def test_main_path_stays_in_the_engine(spark):
    plan = m.drop_repeated_lines(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
