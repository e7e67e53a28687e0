"""Alignment of two tokenizers: diagonals, pieces, stitching, against a plain version."""

import collections
import hashlib

import numpy as np
import pytest

from tabflow.llm.alignment import PieceEncoder, align, diagonals, pair_counts, aligned_slices
from tabflow.llm.tokens import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a <|endoftext|> b", "<s> x </s> <unk>", "a▁b", "  two  spaces ", " lead", "x ", "\n\n", "é ü 漢字 \U0001f600‍", "tab\tand\x00nul", "　wide\xa0", "ﬁ ① é", "don't we'll  I'm", "1234567 89.0", " "]


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path(B))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printed)}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], []
        ends = lambda ids, parts: list(zip(ids, np.cumsum([len(p) for p in parts]).tolist()))
        return ends(ids_a, bytes_a), ends(ids_b, bytes_b)

    return tokens


def brute(plain, texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest; every pair of tokens is tested for overlap nearby."""
    found, counts = [], collections.Counter()
    for text in texts:
        a, b = plain(text or "")
        both = sorted({e for _, e in a} & {e for _, e in b})
        groups, at = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in a if at < x <= e) + "|" + ",".join(str(i) for i, x in b if at < x <= e))
            at = e
        links, j = [], 0
        for k, (i, end) in enumerate(a):
            begin = a[k - 1][1] if k else 0
            while j and b[j - 1][1] > begin:
                j -= 1
            while j < len(b) and (b[j - 1][1] if j else 0) < end:
                if b[j][1] > begin:
                    links.append((i, b[j][0]))
                j += 1
        counts.update(set(links))
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = collections.defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(n_a, n_b, g, len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), d) for n_a, n_b, g, x, d in found]


def test_diagonals_cut_a_merge_evenly():
    rng = np.random.default_rng(1)
    for _ in range(200):
        top = int(rng.integers(2, 60))
        a = np.append(np.flatnonzero(rng.random(top) < rng.random()) + 1, top + 1)
        b = np.append(np.flatnonzero(rng.random(top) < rng.random()) + 1, top + 1)
        work = int(rng.integers(2, 9))
        cut = diagonals(a, b, work)
        assert cut[0] == (0, 0) and cut[-1] == (len(a), len(b)) and cut == sorted(cut)
        for k, ((i, j), (i1, j1)) in enumerate(zip(cut, cut[1:])):
            own, later = [*a[i:i1], *b[j:j1]], [*a[i1:], *b[j1:]]
            assert not own or not later or max(own) < min(later)
            assert abs(i1 + j1 - i - j - work) <= 1 or k == len(cut) - 2


def test_pieces_equal_the_plain_call(rows):
    from sentencepiece import SentencePieceProcessor

    model, fast = SentencePieceProcessor(model_file=tokenizer_path(B)), PieceEncoder(tokenizer_path(B))
    for text in [*ODD, *(r[1] for r in rows if r[1])]:
        assert fast.encode(text).tolist() == model.encode(text), text


@pytest.mark.parametrize("options", [{}, {"work": 64, "slice_pairs": 300}])
def test_documents_equal_brute_force(spark, docs, rows, plain, options):
    extra = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = align(docs.select("doc_id", "text", "kept", "size").unionByName(extra, allowMissingColumns=True), tokenizer_path(A), tokenizer_path(B), **options)
    every = [(r[0], r[1]) for r in rows] + [(900 + i, t) for i, t in enumerate(ODD)]
    want = [(i, *x) for (i, _), x in zip(every, brute(plain, [t for _, t in every]))]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_pair_counts_and_empty_table(spark, docs, none, rows, plain):
    known = {r.pair: (r["count"], r.best) for r in pair_counts(aligned_slices(docs, tokenizer_path(A), tokenizer_path(B))).collect()}
    assert max(n for n, _ in known.values()) <= len(rows) and any(b for _, b in known.values())
    assert align(none, tokenizer_path(A), tokenizer_path(B)).count() == 0
    assert align(docs.filter("text IS NULL"), tokenizer_path(A), tokenizer_path(B)).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]
