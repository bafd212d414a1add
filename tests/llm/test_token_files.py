"""Token files: exact ids, round trips of grammars, places and checksums, random access, odd rows."""

import random
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\n\n", " \n", "'s", "don't", "<|endoftext|>", "é", "é", "β", "日本", "123", "a1b2", "...", "\t", "\x85", "\x1c", " ", "Hello", "it's", "'d\n", "\r\n", "_", "<|", "😀", "$", "ß", "word"]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["stone", "river.", "Mill,", "über", "end.\nNew", "x"]) for _ in range(40)) for _ in range(500)]
    monkeypatch.setattr(token_files, "REMEMBERED", 300)  # both generations come into use
    made = token_files.Encoder(PATH)
    assert made.cuts
    got = [ids for lo in range(0, len(texts), 250) for ids in made.ids(texts[lo : lo + 250])]
    assert got == made.whole(texts)


def test_other_tokenizers_encode_whole_texts():
    made = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not made.cuts and made.ids(["a b", ""]) == made.whole(["a b", ""])


def test_bookkeeping_of_pieces_takes_no_calls_of_python():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)) for _ in range(100)]
    made, calls = token_files.Encoder(PATH), []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        got = made.ids(texts)
    finally:
        sys.setprofile(None)
    assert got == made.whole(texts) and len(calls) < 2500  # of 5,000 words


class _Watched:
    """A tokenizer, and the characters it was given."""

    def __init__(self, own):
        self.own, self.chars = own, 0

    def encode_batch_fast(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.own.encode_batch_fast(texts, **more)


def test_texts_with_paragraphs_are_encoded_by_pieces_too():
    texts = ["one stone  river.\n\nA mill,  नमस्ते \n stone\n" * 3] * 200
    made = token_files.Encoder(PATH)
    whole = made.whole(texts)
    made.tokenizer = watched = _Watched(made.tokenizer)
    assert made.ids(texts) == whole and watched.chars < 200
    assert made.ids(texts) == whole and watched.chars < 200


def test_short_texts():
    for text in ["a", "é", "", ".", "\n", " ", "語", "\xa0", "a\n", "\na", "a.", "é.\n"]:
        made = token_files.Encoder(PATH)
        assert made.ids([]) == [] and made.ids([text]) == made.whole([text]) and made.ids([text, "", text]) == made.whole([text, "", text])


def test_long_pieces_are_not_remembered():
    made = token_files.Encoder(PATH)
    texts = [f"a stone {str(i) * 2000} " + "日本語" * 500 + str(i) for i in range(20)]
    assert [made.ids([x])[0] for x in texts] == made.whole(texts) and made.pieces.nbytes < 2000


def test_added_tokens_that_go_across_cuts(tmp_path):
    made = token_files.Encoder(PATH)
    made.tokenizer.add_tokens(["New York"])
    made.tokenizer.save(str(tmp_path / "more.json"))
    more = token_files.Encoder(str(tmp_path / "more.json"))
    assert more.ids(["in New York, now"]) == more.whole(["in New York, now"])


def test_texts_are_encoded_some_at_a_time(monkeypatch):
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = ["one two three", None, "", "four" * 30, "é.\nfive", None]
    batches = [pa.record_batch({"doc_id": pa.array(range(lo, lo + 3)), "text": pa.array(texts[lo : lo + 3], pa.string())}) for lo in (0, 3)]
    found = []
    for at_once in (1, 14, 130, 1 << 20):
        monkeypatch.setattr(token_files, "AT_ONCE", at_once)
        found.append([row for x in token_files._shards(PATH, pa.int64(), iter(batches)) for row in x.to_pylist()])
    assert found[1:] == found[:-1] and [x["doc_id"] for x in found[0][0]["docs"]] == list(range(6))
    assert found[0][0]["n"] == sum(len(x) // 4 + 1 for x in token_files.Encoder(PATH).whole([x or "" for x in texts]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
@pytest.mark.parametrize("kinds", [1, 2, 7, 400])
def test_grammars_give_ids_back(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n).astype("<u4")
    data = token_files.compress(ids)
    grammar = token_files.Grammar(data)
    assert grammar.n == n and (grammar.ids() == ids).all()
    for _ in range(20):
        start = int(rng.integers(0, n + 1))
        size = int(rng.integers(0, n - start + 1))
        assert (grammar.ids(start, size) == ids[start : start + size]).all()
    # Rules stand for as many ids as is written, each is used, and a sequence with repeats shrinks.
    assert [len(grammar._unfolded(np.array([grammar.base + i], np.uint32))) for i in range(len(grammar.rules))] == grammar.spans.tolist()
    if n == 40_000 and kinds < 10:
        assert len(data) < 2 * n
    with pytest.raises(ValueError):
        token_files.Grammar(b"none" + data[4:])


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_the_most_frequent_pair_goes_first(kind):
    seq = np.array([1, 2, 3] * 20 + [2, 3] * 20 + [5, 5, 5, 5, 5] * 3, kind)
    left, right, shorter = token_files._round(seq, 100)
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    assert pairs[0] == (2, 3) and (shorter == 100).sum() == 40 and (1, 2) not in pairs
    assert (shorter == 100 + pairs.index((5, 5))).sum() == 7


def test_large_vocabularies():
    ids = np.array([70_000, 9, 80_000] * 500, "<u4")
    data = token_files.compress(ids)
    assert (token_files.Grammar(data).ids() == ids).all() and len(data) < 2000


def test_checksums_of_stretches_join():
    rng = random.Random(1)
    for a, b in ((0, 0), (5, 0), (0, 5), (1000, 3), (7, (1 << 20) + 9)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert token_files._join(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


def expected(rows):
    """doc_id, start, n_tokens and ids_crc32 by hand: null ids last."""
    made, start, out = token_files.Encoder(PATH), 0, []
    for doc_id, text in rows:
        ids = made.whole([text or ""])[0] + bytes(4)
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("shard", [16, 1 << 18])
def test_documents_come_back_from_files(spark, documents, odd, tmp_path, monkeypatch, shard):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["old", "mill", "stone", "river"]) for _ in range(rng.randrange(60)))) for i in range(100, 160)]
    rng.shuffle(odd)
    path = str(tmp_path / "files")
    # The workers are processes of their own: a small shard is passed with the function.
    monkeypatch.setattr(token_files, "SHARD", shard)
    if shard == 16:
        monkeypatch.setattr(token_files, "_shards", _with_shard(shard))
    token_files.write(documents([*odd, *rows], clash=True).repartition(5), path, PATH)
    found = [tuple(r) for r in token_files.read(spark, path).orderBy("start").collect()]
    ranked = sorted([*odd, *rows], key=lambda r: (r[0] is None, r[0] or 0))
    assert found == expected(ranked)
    some = token_files.fetch(spark, path, spark.createDataFrame([(101,), (140,), (5,), (None,), (999,)], "doc_id long")).orderBy("d", "place").collect()
    texts, got = dict(rows) | {5: dict(odd)[5]}, {}
    for r in some:
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    made = token_files.Encoder(PATH)
    assert got == {d: [*np.frombuffer(made.whole([texts[d]])[0], "<u4").tolist(), 0] for d in (101, 140, 5)}


def _with_shard(shard):
    own = token_files._shards

    def work(path, kind, batches):
        from quarry.llm import token_files as there

        before, there.SHARD = there.SHARD, shard
        try:
            yield from own(path, kind, batches)
        finally:
            there.SHARD = before

    return work


def test_an_empty_table(spark, documents, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(documents([]), path, PATH)
    assert token_files.read(spark, path).collect() == []


def test_text_ids_and_repeated_rows(spark, tmp_path):
    rows = [("b", "one two"), ("a", "x"), ("b", "one two"), ("b", "other")]
    path = str(tmp_path / "files")
    token_files.write(spark.createDataFrame(rows, "doc_id string, text string"), path, PATH)
    found = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == ["a", "b", "b", "b"] and sorted(r["ids_crc32"] for r in found) == sorted(x[3] for x in expected(rows))
