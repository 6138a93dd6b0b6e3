import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_cases import empty, frame, odd_rows, prose
from tokenizers import Tokenizer

from framewright.llm import op13_alignment as m

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, other = {}, 256
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(other)] = b
            other += 1
    return table


@pytest.fixture(scope="module")
def whole():
    """The tokens of a whole text as (id, start, end), by each tokenizer; None where bytes differ."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    byte_of = letters()

    def spans(tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def run(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        right = [
            (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
            for i in b.encode(text)
        ]
        want = (" " + text).encode()
        if b"".join(x[1] for x in left) != want or b"".join(x[1] for x in right) != want:
            return None
        return spans(left), spans(right)

    return run


def expected(rows, whole):
    documents, best, found = Counter(), {}, []
    for r in rows:
        both = whole(r[1])
        links, groups = [], []
        if both:
            a, b = both
            links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else None
            cuts = sorted({x[2] for x in a} & {y[2] for y in b})
            at = 0
            for cut in cuts:
                groups.append(
                    ",".join(str(x[0]) for x in a if at < x[2] <= cut) + "|" + ",".join(str(y[0]) for y in b if at < y[2] <= cut)
                )
                at = cut
        found.append((r[0], both, groups, links))
        documents.update(set(links))
    for (a, _), n in documents.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, both, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if both else ""
        top = sum(documents[p] == best[p[0]] for p in links)
        sizes = (len(both[0]), len(both[1])) if both else (0, 0)
        out.append((i, *sizes, len(groups), len(links), top, sum(documents[p] for p in links), digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


ODD_TEXTS = [
    " lead", "trail ", "two  blanks   here", "a\nb\n c \n", "\t", " ", "  ", "▁x and ▁", "a ▁b",
    "<|endoftext|> and <s> </s> <unk> <0x41> text", "漢字 仮名 😀 ok", "no break   x", "don't we'll 's it", "1234 5,678.90!",
    "é ́ x", "\x00 nul", "a\x1c b", "　wide", "x" * 300 + " " + "é" * 80, "ﬁ ½ ™",
]


def short(rows):
    return [r if r[1] is None or len(r[1]) < 5000 else (r[0], r[1][:5000], *r[2:]) for r in rows]


def mixed_rows(n, seed):
    rng = random.Random(seed)
    parts = ODD_TEXTS + [prose(i, 6) for i in range(20)]
    return [(i, rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randrange(1, 6))), "en", "a", 0) for i in range(n)]


def test_against_whole_texts(spark, whole):
    rows = [(100 + i, t, "en", "a", 0) for i, t in enumerate(ODD_TEXTS)] + short(odd_rows()) + mixed_rows(60, 5)
    assert found(m.alignment_counts(frame(spark, rows), PATH_A, PATH_B)) == expected(rows, whole)


@pytest.mark.parametrize("known", [0, 40])
def test_pairs_beyond_the_broadcast(spark, whole, known):
    rows = mixed_rows(40, 6) + short(odd_rows())
    assert found(m.alignment_counts(frame(spark, rows), PATH_A, PATH_B, known_pairs=known)) == expected(rows, whole)


def test_given_documents(spark, sf_dir, whole):
    """Whole-text encoding and a plain walk over both end lists, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in m.align(docs, PATH_A, PATH_B, groups=True).collect()}
    for r in docs.collect():
        a, b = whole(r["text"])
        cuts = {x[2] for x in a} & {y[2] for y in b}
        mine = got[r["doc_id"]]
        assert (mine["n_a"], mine["n_b"], mine["n_groups"]) == (len(a), len(b), len(cuts))
        # A link ends where one of its tokens ends; ends in both lists count once.
        assert mine["n_links"] == sum(mine["times"]) == len(a) + len(b) - len(cuts)
        flat = [g.split("|") for g in mine["groups"].split(";")]
        assert [int(x) for g in flat for x in g[0].split(",")] == [x[0] for x in a]
        assert [int(x) for g in flat for x in g[1].split(",")] == [x[0] for x in b]


def test_ranges_and_common_ends():
    """Against a plain comparison of all token ranges, the shorter list driving."""
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 80)
        a, b = ([*sorted(rng.sample(range(1, size), rng.randrange(size))), size] for _ in range(2))
        firsts, lasts, swapped = m.intersect(a, b)
        short, long = (b, a) if swapped else (a, b)
        assert len(short) <= len(long)
        spans = [[*zip([0, *ends], ends, strict=False)] for ends in (short, long)]
        over = [[j for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]] for x in spans[0]]
        assert [(o[0], o[-1]) for o in over] == [*zip(firsts, lasts, strict=True)]
        ids = [np.arange(len(x)) for x in (a, b)]
        aligned = m.Aligned(*ids, a, b)
        assert [a[c - 1] for c in aligned.cuts_a] == [b[c - 1] for c in aligned.cuts_b] == sorted({*a} & {*b})
        assert sorted(aligned.links.tolist()) == sorted(
            (j << 32 | i) if swapped else (i << 32 | j) for i, o in enumerate(over) for j in o
        )


def test_both_encoders_of_a_agree():
    aligner = m.Aligner(PATH_A, PATH_B)
    assert aligner.fast_a is not None
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(1, 0x3000), *range(0x1F300, 0x1F700)]] + list(" \n\t'sdlretvm0123.,") * 300
    texts = ODD_TEXTS + ["".join(rng.choices(letters, k=200)) for _ in range(400)]
    fast = aligner.encode(texts)[0]
    aligner.fast_a = None
    assert aligner.encode(texts)[0] == fast


def test_very_long_text(spark, whole):
    text = prose(3, 60_000) + "\n" + "y" * 20_000
    (got,) = m.align(frame(spark, [(1, text, "en", "a", 0)]), PATH_A, PATH_B).collect()
    a, b = whole(text)
    cuts = {x[2] for x in a} & {y[2] for y in b}
    assert (got["n_a"], got["n_b"], got["n_groups"]) == (len(a), len(b), len(cuts))


def test_nothing(spark):
    assert m.alignment_counts(empty(spark), PATH_A, PATH_B).collect() == []
