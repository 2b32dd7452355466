import pytest

from quillmark.llm import token_counts as T
from quillmark.llm.shared import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(pieces, byte_pieces):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", 0.0), *pieces]
    if byte_pieces:
        vocab += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    # byte pieces are never matched in text, and unknown characters fall back to them
    t = Tokenizer(models.Unigram(vocab, 0, byte_pieces))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(T.MARK, "always", False)])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = ["", " \n", "a", "hello world", "The quick brown fox", "Größe élève ñandú", "日本語 テキスト", "😀😀 x😀y", "aaaaaaaaaaaaaaaa", "a\x0bb\x0cc", "\u00a0x", "12345 67.89", "<0x41> </s>"]


def test_counts_are_the_tokenizers(prose):
    pieces, has_bytes = T.vocabulary(PATH)
    counter, count = T.Counter(pieces, has_bytes, words_kept=5), reference(pieces, has_bytes)
    for text in [*TEXTS[:-1], prose(1, 500), " ".join(prose(i, 1) + "ß%&" for i in range(200))]:
        assert counter.count(text) == count(text), text


def test_ties_keep_the_earlier_start_and_unknowns_fuse():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aab", -3.0)]
    counter, count = T.Counter(pieces, False), reference(pieces, False)
    for text in ["a", "aa", "aaa", "aab", "aaab", "baab", "xx", "axxa", "xa xx", "aaaaaa", "xyz"]:
        assert counter.count(text) == count(text), text


def test_operator(spark):
    rows = [(i, t, 5) for i, t in enumerate([*TEXTS, None, "a", "long " * 30_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in T.count_tokens(docs, path=PATH, keep=["doc_id", "n_tokens"]).collect()}
    assert found[0] == found[1] == found[len(TEXTS)] == (0, 0) and found[2] == found[len(TEXTS) + 1] and found[len(TEXTS) + 2][0] == 30_000
    assert T.count_tokens(docs.limit(0), path=PATH).columns == ["doc_id", "text", "n_words", "n_tokens"]
    assert T.count_tokens(docs.limit(0), path=PATH).count() == 0


def test_scores_are_normed():
    import math

    pieces, _ = T.vocabulary(PATH)
    assert sum(math.exp(s) for _, s in pieces) == pytest.approx(1)
