import random

import pyarrow as pa
import pytest
import sentencepiece

from newsloom.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = queries.vocabulary(queries.PIECE_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    r = random.Random(7)
    texts = ["", " ", "  a", "▁", "▁▁a ▁ ", "\x00a\x00", "<s>hi</s><0x0A> <unk>", "日本語テキスト" * 300, "😀é̂ñ" * 400, "a\n\n\tb\r\n" * 400]
    texts += [" " * 5000, "a" * 30_000, "ab" * 9_000, "=" * 7000, "qzj" * 4000, "x" * 511 + " y", "x" * 512, "é" * 256 + "z"]
    texts += ["".join(r.choice("abc ▁\né日t") for _ in range(r.randint(1, 3000))) for _ in range(20)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FFF), r.randint(0x10000, 0x10FFFF)])) for _ in range(1500)) for _ in range(4)]
    return texts + ["".join(r.choice("etaoin shrdlu") for _ in range(9000))]


def test_counts_equal_the_library(library):
    texts = odd_texts()
    found = token_counts.transducer(PATH).column(pa.array([*texts, None]))
    assert found.tolist() == [len(library.encode(t)) for t in texts] + [0]


def test_guesses_never_change_a_count(library, monkeypatch):
    """Short chunks without a look back, few tries and a small table: the same counts."""
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "BEFORE", 1)
    monkeypatch.setattr(token_counts, "GUESSES", 2)
    monkeypatch.setattr(token_counts, "STATES", 50)
    machine = token_counts.Transducer(PATH)
    texts = [t[:1500] for t in odd_texts()]
    for part in (texts[:15], texts[15:]):
        assert machine.column(pa.array(part)).tolist() == [len(library.encode(t)) for t in part]


def test_single_transitions_sum_to_the_prefix_counts(library):
    machine, text = token_counts.transducer(PATH), "The unbelievably internationalised  tokenizer’s output"
    state, total = machine.states[machine.first][0], machine.first_count
    for i, c in enumerate(text):
        state, added = machine.step(state, "▁" if c == " " else c)
        total += added
        assert total == len(library.encode(text[: i + 1]))


def test_unlike_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "x.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.Transducer(str(tmp_path / "x.model"))


def test_every_row_is_counted(docs, docs_rows, empty, library):
    rows = token_counts.count_tokens(docs, PATH).collect()
    wanted = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in docs_rows]
    assert sorted(map(tuple, rows), key=lambda x: (x[0] is None, x[0] or 0, x)) == sorted(wanted, key=lambda x: (x[0] is None, x[0] or 0, x))
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_query_on_whole_tables(spark, library):
    found = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in found.items()} == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
