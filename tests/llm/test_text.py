"""Words, shingles and token ids against their plain definitions."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabflow.llm.tokens import Encoder, tokenizer_path
from tabflow.llm.words import sequence_hashes, shingle_sets, words
from tests.llm import corpus

TEXTS = [r[1] for r in corpus.documents()]
ODD = ["  a  b \n c", "<|endoftext|> x", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|> <|endoftext|", "<|endoftext|>" * 3, " ", "", "a ́b", "It's 12 345 \t x  \n\n y ", "\x1c a \x85b ​ c", "x • y•z", "don't stop", "a\xa0 b", "᠎ x", "foo's 'tis", "ÀÉ Ñandú straße İx", "end "]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoders(request):
    path = tokenizer_path(request.param)
    return Encoder(path), Tokenizer.from_file(path)


def test_encoder_gives_the_ids_of_the_whole_text(encoders):
    ours, plain = encoders
    for text, ids in zip(TEXTS + ODD, ours.encode(TEXTS + ODD), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_as_plain_text(name):
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    for text, ids in zip(ODD, Encoder(tokenizer_path(name), plain=True).encode(ODD), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 'éÑ.•\n\t\xa0 ́́12🙂,s")), max_size=30), max_size=4))
def test_encoder_on_any_mixture_of_blanks(texts):
    ours, plain = test_encoder_on_any_mixture_of_blanks.pair
    assert [x.tolist() for x in ours.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


test_encoder_on_any_mixture_of_blanks.pair = (Encoder(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")))


def test_a_full_cache_changes_nothing(monkeypatch, encoders):
    from tabflow.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    ours, plain = encoders
    ours.known = {}
    for text, ids in zip(TEXTS[:60], ours.encode(TEXTS[:60]), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_a_word_is_learned_once_whatever_stands_after_it(encoders):
    """Learning is most of the work: each word once, not once with every mark or line that follows it."""
    ours, plain = encoders
    ours.words, learned, merged = {}, [], ours._merged
    ours._merged = lambda pieces, blank="": learned.extend(pieces) or merged(pieces, blank)
    texts = ["x Straße Straße, Straße. Straße!\nStraße Straße,\nno (Straße) Straße\nno,\nno", None, "", "x Straße;\n\nno Straße\n no  Straße?\u2028no"]
    for given in (texts, pa.array(texts), pa.array(["cut", *texts]).slice(1)):
        for text, ids in zip(texts, ours.encode(given), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert learned.count("Straße") <= 2 and learned.count("no") <= 2


@pytest.mark.parametrize("run_bytes", [1, 3000, 1 << 30])
def test_runs_of_texts_change_nothing(monkeypatch, encoders, run_bytes):
    from tabflow.llm import tokens

    monkeypatch.setattr(tokens, "RUN_BYTES", run_bytes)
    ours, plain = encoders
    for text, ids in zip(ODD + TEXTS[:60], ours.encode(pa.array(ODD + TEXTS[:60])), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_words_of_slices(most):
    found = []
    for w in words(pa.array(TEXTS).slice(1), most=most):
        assert w.row == len(found)
        for k in range(w.texts):
            a, b = w.first[k], w.first[k + 1]
            found.append([bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
    assert found == [corpus.words(t) for t in TEXTS[1:]]


def test_shingles_are_equal_exactly_where_the_words_are():
    names = {}
    for w in words(pa.array(TEXTS), lower=True, most=5000):
        for k, found in enumerate(shingle_sets(w, 5)):
            names[w.row + k] = set(found.tolist())
    plain = [corpus.shingles(t) for t in TEXTS]
    for a in range(0, len(TEXTS), 3):
        assert len(names[a]) == len(plain[a])
        for b in range(a):
            assert len(names[a] & names[b]) == len(plain[a] & plain[b])


def test_runs_of_other_lengths_differ():
    w = next(words(pa.array(["a b c"])))
    assert len(set(sequence_hashes(w.hash, 1).tolist() + sequence_hashes(w.hash, 2).tolist() + sequence_hashes(w.hash, 3).tolist())) == 6


def test_line_templates_cut_texts_into_lines_twice(spark, monkeypatch):
    """Whole lines and leaves come from one pass; the places of lines in leaves that recur from a second one."""
    from tabflow.llm import line_templates

    plans, materialize = {}, line_templates.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(line_templates, "materialize", kept)
    texts = [(i, f"one two three four {i}\nsame line of some words\nonly {i}") for i in range(12)]
    drops = line_templates.recurring_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(drops) == 11 and all(0 in r["drop"] and 1 in r["drop"] for r in drops)
    assert sum("posexplode" in plans[n] and "split(" in plans[n] for n in ("line-wholes", "line-leaves", "line-tokens")) == 2
