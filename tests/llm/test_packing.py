import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagestream.llm import packing as P
from pagestream.llm.queries import op6_packing, word_tokenizer


def check(lengths, limits, prompts=None):
    prompts = prompts or [0] * len(lengths)
    doc, start, length, sequence, offset, loss = (x.tolist() for x in P.pack(np.array(lengths, np.int64), limits, np.array(prompts, np.int64)))
    seen, rows = {}, {}
    for d, s, n, q, o, x in zip(doc, start, length, sequence, offset, loss, strict=True):
        assert n > 0 and x == sum(k >= prompts[d] for k in range(s, s + n))
        seen.setdefault(d, []).append((s, n))
        rows.setdefault(q, []).append((o, n, x))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n
    sizes = []
    for x in rows.values():
        at = 0
        for o, k, _ in sorted(x):
            assert o == at
            at += k
        assert at <= limits.tokens and len(x) <= limits.segments and sum(z for _, _, z in x) <= limits.loss_tokens
        sizes.append(at)
    return sizes


def test_pack_keeps_all_limits_and_pads_little():
    r = random.Random(1)
    for limits in (P.Limits(64, 8, 64), P.Limits(64, 64, 40), P.Limits(32, 2, 32), P.Limits(16, 16, 16)):
        for n in (1, 2, 50, 300):
            lengths = [r.choice([1, 2, 3, r.randrange(1, 200)]) for _ in range(n)]
            sizes = check(lengths, limits, [r.randrange(0, x + 1) for x in lengths])
            open_ = [s for s in sizes if s != limits.tokens and s & (s - 1)]
            if limits.segments == limits.loss_tokens == limits.tokens:
                assert not open_


def longest_fit(lengths, losses, limits):
    """Sequences that 'the longest that fits' opens for uncut pieces."""
    left, n = sorted(zip(lengths, losses, strict=True), reverse=True), 0
    while left:
        n, free, loss = n + 1, limits.tokens, limits.loss_tokens
        k = 0
        while k < len(left):
            if left[k][0] <= free and left[k][1] <= loss:
                free, loss = free - left[k][0], loss - left[k][1]
                left.pop(k)
            else:
                k += 1
    return n


def test_dot_product_beats_length_alone():
    # Many answers without a prompt, and long prompts: who only looks at lengths puts prompts together, and answers are left over.
    r = random.Random(2)
    limits = P.Limits(tokens=100, segments=100, loss_tokens=50)
    pieces = [(r.randrange(30, 60), 0.1) for _ in range(200)] + [(r.randrange(20, 45), 0.9) for _ in range(280)]
    lengths, prompts = [n for n, _ in pieces], [n - int(n * share) for n, share in pieces]
    by_length = longest_fit(lengths, [n - p for n, p in zip(lengths, prompts, strict=True)], limits)
    least = max(sum(lengths) / limits.tokens, sum(n - p for n, p in zip(lengths, prompts, strict=True)) / limits.loss_tokens)
    packed = len(check(lengths, limits, prompts))
    print(by_length, packed, least)
    assert least <= packed < by_length


def brute_ids(text, model):
    return model.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_tokenizer_equals_the_library():
    model = Tokenizer.from_file(word_tokenizer())
    model.encode_special_tokens = True
    texts = ["Hello, World! it's 2024", None, "", "a\n\n  b\tc\r\nd", "é́ ﬁ İstanbul ΣΑΣ. ΟΔΟΣ x", "<|endoftext|> <|startoftext|>x", "   nb  em　id \x1c\x85 ctl", "中文字 テスト 😀😀 é", "don't we'll I'M 'tis x's", "a" * 500, "﻿bom ​zw"]
    texts += ["First line, x.\nSecond.\nThird é. x\n", "\n", "Ä, b! c\n\nd"]
    own = P.WordTokenizer(word_tokenizer())
    for _ in range(2):  # the second time all words are known
        ids, offsets, prompt = own.encode(pa.array(texts, pa.string()), 1, 1)
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == brute_ids(t, model), t
            first = t.split("\n")[0] if t and "\n" in t else ""
            assert prompt[k] == len(model.encode(first, add_special_tokens=False).ids), t


def test_query_round_trip(spark):
    model = Tokenizer.from_file(word_tokenizer())
    model.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got, rows = {}, {}
    for r in op6_packing(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, []).append(r)
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids, at = np.array(brute_ids(t, model), "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for x in rows.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_edge_cases(spark):
    rows = [(1, None), (None, ""), (2, "x"), (2, "x")]
    got = P.packed(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()).collect()
    assert sum(r.length for r in got) == 6 and sum(r.doc_id is None for r in got) == 1
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []
