import struct

import pytest

from quillmark.llm import packing as P
from quillmark.llm.byte_bpe import Encoder
from quillmark.llm.shared import tokenizer_file, tokenizer_pattern

PATH, PATTERN = tokenizer_file("byte_bpe_50k.json"), tokenizer_pattern()
ODD = ["", " ", "  a", "a  b", "a   b ", "a \n b", "a\n\n b", "a \nb\t c", "x\u00a0 y", "x \u2003y", "tail  ", "é è  ñ", "it's 12 34!! ''s", "😀 😀  z", "<|endoftext|> a", "\x1c \x1d b", "a\x85 b", " lead", "\n"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers(reference, prose):
    encoder = Encoder(PATH, PATTERN)
    for text in [*ODD, prose(1, 300), prose(2, 300).replace(" ", "  ", 9), "Wörter&&& und%%% Zahlen 123"]:
        ids = list(struct.unpack(f"<{len(encoder.packed(text)) // 2}H", encoder.packed(text)))
        assert ids == reference(text) == encoder.whole(text)


@pytest.mark.parametrize("window", [8, 64])
def test_pieces_make_up_the_stream(spark, reference, prose, window):
    texts = [*ODD, None, prose(1, 500), prose(1, 500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    pieces = P.pack(docs, path=PATH, pattern=PATTERN, window=window).collect()
    ids = {d: [*(reference(t) if t else []), 1] for d, t, _ in rows}
    by_doc = {}
    for p in pieces:
        got = list(struct.unpack(f"<{len(p.ids) // 4}I", p.ids))
        assert len(got) == p.length and p.doc_tokens == len(ids[p.doc_id]) and ids[p.doc_id][p.start : p.start + p.length] == got
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
    for d, spans in by_doc.items():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == len(ids[d])
    assert set(by_doc) == set(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length, p.padded_length))
    total, last = sum(map(len, ids.values())), max(by_sequence)
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for n, spans in by_sequence.items():
        spans.sort()
        used = sum(s[1] for s in spans)
        assert [s[0] for s in spans] == [sum(x[1] for x in spans[:i]) for i in range(len(spans))]
        assert used == spans[0][2] == (window if n < last else total - last * window)
        assert spans[0][3] == (used if used & (used - 1) == 0 else window)


def test_empty_table_and_one_empty_text(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert P.pack(docs.limit(0), path=PATH, pattern=PATTERN).count() == 0
    only = P.pack(docs, path=PATH, pattern=PATTERN).first()
    assert (only.length, only.sequence_length, only.padded_length) == (1, 1, 1)
