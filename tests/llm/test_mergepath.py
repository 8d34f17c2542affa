import collections
import hashlib
import random

import edge
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sweepframe.llm import mergepath

A = Tokenizer.from_file(public_tokenizers.path(mergepath.MODEL_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(mergepath.MODEL_B))
LETTERS = mergepath.byte_letters()


def tokens(text):
    """Ids and bytes of both tokenizers by the plain libraries; None where the bytes don't come back."""
    if not text:
        return None
    raw = (" " + text).encode()
    ia = A.encode(" " + text, add_special_tokens=False).ids
    ib = B.encode(text)
    xa = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in ia]
    xb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    return (ia, xa, ib, xb) if b"".join(xa) == raw == b"".join(xb) else None


def by_hand(rows):
    done, counts = [], collections.Counter()
    for doc_id, text in rows:
        got = tokens(text)
        if got is None:
            done.append((doc_id, 0, 0, 0, [], ""))
            continue
        ia, xa, ib, xb = got
        ends_a, ends_b = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = dict(zip(ends_a, ia)), dict(zip(ends_b, ib))
        links = [(at_a[e], at_b[e]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            x, y = i, j
            while i < len(ia) and ends_a[i] <= e:
                i += 1
            while j < len(ib) and ends_b[j] <= e:
                j += 1
            groups.append(",".join(map(str, ia[x:i])) + "|" + ",".join(map(str, ib[y:j])))
        counts.update(links)
        done.append((doc_id, len(ia), len(ib), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(((d, na, nb, ng, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
                   for d, na, nb, ng, links, sha in done), key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("frequent", [mergepath.FREQUENT, 200, 0])
def test_edge_rows(spark, frequent):
    """With all, some or none of the pairs sent to the workers."""
    want = by_hand([(t[0], t[1]) for t in edge.TEXTS])
    assert found(mergepath.cross_alignment(edge.frame(spark), frequent=frequent)) == want


def test_empty_table(spark):
    assert mergepath.cross_alignment(edge.empty(spark)).count() == 0


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(mergepath.op13_token_alignment(spark, SF)) == by_hand(rows)


def test_odd_texts(spark):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t ", " \n", "a", "word", "Ünï", "ﬁ", "😀", "▁", "<s>", "<|endoftext|>", "́", " ", "　", "\x00", "12", "...", "'s", "<0x41>", "日本"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(mergepath.cross_alignment(frame, frequent=500)) == by_hand(rows)


ends = st.lists(st.integers(1, 400), unique=True, max_size=120).map(sorted).map(lambda v: np.array(v, np.int64))


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.integers(1, 50))
def test_pieces_merge_like_one_list(a, b, work):
    i, j = mergepath.overlaps(a, b, work)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[i].tolist() == b[j].tolist() == both
    cut_a, cut_b = mergepath.diagonals(a, b, work)
    sizes = np.diff(cut_a) + np.diff(cut_b)
    assert (sizes[:-1] == work).all() and (sizes <= work).all()
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    for x, y in zip(cut_a.tolist(), cut_b.tolist()):
        assert sum(s == 0 for _, s in merged[:x + y]) == x


def test_groups_are_texts(spark):
    rows = [(1, "tokenizers differ"), (2, None)]
    made = mergepath.alignments(spark.createDataFrame(rows, "doc_id long, text string"), groups=True).collect()
    assert {r.doc_id: r.groups_sha256 for r in made} == {1: hashlib.sha256(made[0].groups.encode() if made[0].doc_id == 1 else made[1].groups.encode()).hexdigest(), 2: ""}
