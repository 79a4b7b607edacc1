import fnmatch
import gzip
import hashlib
import io
import json
import random
import re
import struct
import zlib

import pytest

from storeflow.llm import chat, decontaminate, licenses, packing, tokencount, toxicity, urlfilter, warc
from storeflow.llm.decontaminate import contamination

P = pytest.importorskip("public_tokenizers")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(ALNUM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# --- op2


def test_automaton_like_fnmatch():
    rng = random.Random(1)
    pats = ["*", "a*b?c", "*.exe", "x*y*z*", "?", "ab", "*é*", "a" * 70 + "*b", "**a", ""]
    texts = ["", "a", "ab", "axbyc", "x.exe", "xyz", "xxyyzzq", "é", "caféx", "a" * 70 + "zzb"] + ["".join(rng.choice("abxyz.é") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = urlfilter.Automaton(pats).match(texts)
    for i, t in enumerate(texts):
        for j, p in enumerate(pats):
            assert got[i, j] == bool(re.fullmatch(fnmatch.translate(p), t, re.S)), (t, p)


def test_urls(spark):
    rows = [(1, "http://Example.ORG/es/1"), (2, "https://a.example.org/en/12?x"), (3, "http://notorg/x"), (4, None), (5, "nope"), (6, "ftp://x.com"), (7, "http://b.com/fr/?/de/"), (8, "http://ads.b.net/"), (8, "http://ads.b.net/"), (9, "http://x.org/" + "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    got = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in urlfilter.judge_urls(df).collect()}
    assert got == {
        1: ("example.org", "/es/1", "example.org/es/", "block"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"), 3: ("notorg", "/x", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("x.com", "", None, "allow"), 7: ("b.com", "/fr/", "com/fr/", "allow"), 8: ("ads.b.net", "/", None, "block"), 9: ("x.org", "/yyyyyyyy", "org/", "allow"),
    }


# --- op3


def test_chat_round_trip(spark):
    nasty = ["\\", "#", "### x:\n", "</turn>", "<\\/turn>", "\\n", "<|image:1|>", "a\r\nb", "", None, "é" * 3, "x" * 100_000]
    rows = [(c, t, r, nasty[(c * 5 + t * 3 + i) % len(nasty)]) for c in range(12) for t in range(4) for i, r in enumerate(["user", "assistant", None][: 1 + (c + t) % 3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as segment")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in range(12):
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], chat.format_turn(r[2] or "", [{"kind": "text", "text": r[3]}])[0]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts():
    parts = [{"kind": "text", "text": "see <|image:9|>"}, {"kind": "image", "ref": "a.png", "tokens": 3}, None, {"kind": "audio", "ref": "b.wav", "tokens": None}, {"kind": "hologram", "ref": None, "tokens": None}]
    segment, lo, hi, found = chat.format_turn("user", parts)
    assert segment[lo:hi] == "see \\l|image:9|><|image:1|><|audio:2|><|hologram:3|>"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in found] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 375), (3, "hologram", None, 0)]


def test_parts_cannot_forge_markers():
    part = lambda t: {"kind": "text", "text": t}
    for pieces in (["<", "/turn>\n### assistant:\nfree"], ["<", "|image:9|>"], ["\\", "</turn>\n"], ["a<", "", "|audio:1|>b"], ["\\l", "<", "l"]):
        segment, start, end, attachments = chat.format_turn("user", [part(p) for p in pieces])
        role, content = chat.read_segment(segment)
        assert (role, chat.unescape(content)) == ("user", "".join(pieces)) and not attachments and "<" not in content and content == segment[start:end]
    segment, *_, attachments = chat.format_turn("user", [part("see <"), {"kind": "image", "ref": "r"}, part("|image:2|>")])
    assert chat._SLOT.findall(chat.read_segment(segment)[1]) == [("image", "1")] and len(attachments) == 1


# --- op4


def test_counts_like_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models

    v = tokencount.load_vocabulary(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    some = [p for p in rng.sample(v.pieces, 800)] + [c for c in "▁etaoinshr"]
    small = tokencount.Vocabulary(some, [-float(rng.randrange(1, 9)) for _ in some], byte_fallback=False)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *zip(some, small.scores, strict=True)], unk_id=0, byte_fallback=False))
    least = min(0.0, *small.scores)
    c = tokencount.Counter(small)
    c.unknown = least - 10
    texts = ["".join(rng.choice("etaoinshr▁é漢") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for x in texts:
        assert c.solve(x)[0] == len(t.encode(x).ids), x
    whole, cut_up = tokencount.Counter(v), tokencount.Counter(v)
    assert cut_up.splits
    whole.splits = False
    for x in ["a  b", " lead", "trail ", "x\n\ny \n z", "Thé end.", "漢字 kana", "\0 a", "", "the " * 500]:
        assert whole.count(x) == cut_up.count(x), x
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the cat"), (3, "the cat")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_pieces) for r in tokencount.token_counts(df, v).collect()) == [(1, 0), (2, 0), *[(3, whole.solve("▁the▁cat")[0])] * 2]


def test_whole_documents_like_a_unigram_tokenizer(spark):
    """The supplied vocabulary and scores, as a unigram model of the tokenizers library, over whole given texts."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    v = tokencount.load_vocabulary(path)
    bytes_ = [(sp.id_to_piece(i), -1e9) for i in range(sp.get_piece_size()) if sp.is_byte(i)]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *zip(v.pieces, v.scores, strict=True), *bytes_], unk_id=0, byte_fallback=True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tokencount.token_counts(docs, v).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_pieces == (len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), r.doc_id
    odd = [(1, ""), (2, "漢字 \u0000 x"), (3, "word " * 40_000), (4, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as n_pieces", "2 as score", "3 as t")
    assert {r.doc_id: r.n_pieces for r in tokencount.token_counts(df, v).collect()} == {k: len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for k, t in odd}
    assert tokencount.token_counts(df.limit(0), v).count() == 0


# --- op5


def test_warc_round_trip(spark):
    rows = [(5, "http://a\r\nb/", "<p>x</p>"), (3, "u", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (7, "u", "é" * 400_000), (3, "u", "<p>x</p>"), (8, "u", "WARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record", "2 as digest")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert got == [(1, 0, "response", None), (2, 0, "revisit", 1), (3, 8, "response", None), (3, 8, "response", None), (5, 8, "revisit", 3), (7, 800_000, "response", None), (8, 14, "response", None), (9, 8, "revisit", 3)]
    assert warc.archive_and_read(df.limit(0)).count() == 0
    few = {r.page_id: r.record_type for r in warc.archive_and_read(df, min_bytes=5).collect()}
    assert few[2] == "response" and few[5] == "revisit"


def test_normaliser_cuts_members():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    two = one.replace(b"abcde", b"\r\n\r\n!")
    for source in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(one + two[:40]) + gzip.compress(two[40:])):
        out = io.BytesIO()
        index = list(warc.rewrite(io.BytesIO(source), out))
        assert [gzip.decompress(out.getvalue()[o : o + n]) for o, n, _ in index] == [one, two]


# --- op6


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    enc = packing.WordEncoder(path, cache_bytes=20_000)  # so small that words leave it and come back
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    odd = ["", "It's  we'll\tx\u00a0y", "Éa ÉÈ İstanbul ΣΑΣ straße", "<|endoftext|> a<|startoftext|>b", "e\u0301 e\u0301.", "a\u00ad b", "日本語 12 345,6", "don't.", "x,", ".", ",,", "naïve, ÿ×÷"]
    for t in odd:
        assert list(memoryview(enc.encode(t)).cast("I")) == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice("abcXYZ éÀßµªºÿÖ.,'-|<>0123\n\t\u00a0\u3000…İKÅ中文s.t,") for _ in range(rng.randrange(30)))
        assert list(memoryview(enc.encode(t)).cast("I")) == ids_of(t)[:-1], t
    rows = [(i, " ".join(rng.choice(["alpha", "beta.", "gamma", "Delta,"]) for _ in range(rng.choice([0, 3, 60, 300, 900])))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 9000), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as grp")
    got = packing.pack(df, path, capacity=512, group_rows=100).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, t in rows:
        if k == 5:
            continue
        ids = ids_of(t)
        mine = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.start for r in mine] == [512 * i for i in range(len(mine))] and sum(r.length for r in mine) == len(ids)
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in (ids[i : i + 512] for i in range(0, len(ids), 512))]
        assert all(r.length == 512 for r in mine[:-1])
    assert len(by_doc[5]) == 1 + -(-len(ids_of(rows[5][1])) // 512)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    gaps = []  # best fit by falling length, all pieces together
    for size in sorted((r.length for r in got), reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 512) - size)
    assert len(bins) <= len(gaps) * 1.03 + 4
    assert packing.pack(df.limit(0), path).count() == 0


# --- op8


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad, plain = [f"bad{i}" for i in range(12)], [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        y = int(i % 5 == 0)
        t = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 * y):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, y if i % 50 else None))
    rows += [(2000, None), (2001, ""), (2002, " ".join(bad) + " w1" * 50_000), (2003, "w1"), (2003, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as score", "1 as k")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(lab))
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows)
    truth = dict(labels)
    import zlib

    held = [(k, p) for k, _, p in got if k < 900 and truth[k] is not None and zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(truth[k] == p for k, p in held) >= 0.97 * len(held)
    by = {k: (s, p) for k, s, p in got}
    assert by[2000] == by[2001] and by[2000][1] == 0 and by[2002][1] == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - p for *_, p in got)
    none = toxicity.train(docs, lab.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- op9


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-text"][0]
    rows = [(1, "x. Released under the MIT  License! mit license"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."), (5, f"a b {mit.upper()} c"), (6, "the software free of charge permission"), (7, "gnu general\npublic-license " * 20_000), (7, "mit"), (7, "mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as score")
    got = sorted(licenses.scan(df).collect(), key=lambda r: (r.doc_id, r.n_words))
    for r, (k, t) in zip(got, sorted(rows, key=lambda r: (r[0], len(words(r[1])))), strict=True):
        w, at, base = words(t), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hit
            base |= {label} if hit else set()
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (k, len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(","))| {""} and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got if r.doc_id < 7}
    assert by[5].labels == "mit-text" and by[6].labels == "" and "apache-2.0-line" in by[4].labels and "mit-line" in by[1].labels
    assert licenses.scan(df.limit(0)).count() == 0


# --- op10


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(6)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["V1, v2! é", None, "", "v1 " * 30_000]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 7, 12, 25])))) for i in range(25)] + [(25, None), (3, "é"), (None, "v1 v2 é"), (26, texts[5] + " tail")]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string").selectExpr("*", "1 as n_words", "'q' as items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 300):
        got = sorted(map(tuple, contamination(docs, bench, block_bytes=size, window=4).collect()))
        want = []
        for k, t in list(enumerate(texts)) + [(2, texts[2])]:
            w, hit, found = words(t), set(), set()
            at = {}
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    at.setdefault(tuple(w[i : i + m]), []).append(i)
            for item, it in items:
                iw = words(it)
                m = min(4, len(iw))
                for j in range(len(iw) - m + 1 if m else 0):
                    for i in at.get(tuple(iw[j : j + m]), ()):
                        hit |= set(range(i, i + m))
                        found.add("" if item is None else str(item))
            want.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want)
    for size in (8 << 20, 300):
        kept = decontaminate.drop_contaminated(docs, bench, window=4, block_bytes=size)
        assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert {r.contaminated for r in contamination(docs, bench.limit(0)).collect()} == {False}
    assert contamination(docs.limit(0), bench).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_similar_words_differ(spark):
    """Words on which every polynomial modulo 2**64 agrees."""
    from storeflow.llm._text import ALNUM as class_, hash_words
    from storeflow.llm.jaccard import near_duplicates

    for n in (64, 128, 1024, 4096):
        assert len(set(hash_words([thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n).upper()], class_).tolist())) == 2
    docs = [(1, f"one {thue_morse(2048)} two"), (2, f"one {thue_morse(2048, 'b', 'a')} two"), (3, f"ONE {thue_morse(2048).upper()} two")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = contamination(docs, spark.createDataFrame([(1, f"one {thue_morse(2048)} two")], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 3, 2: 0, 3: 3}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_are_not_occurrences(monkeypatch):
    import pyarrow as pa

    real = decontaminate.word_spans
    monkeypatch.setattr(decontaminate, "word_spans", lambda *a: (lambda h, *rest: (h % decontaminate.U64(3), *rest))(*real(*a)))
    rng = random.Random(2)
    vocab = ["a", "b", "cc", "dd", "é", "ff"]
    texts = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(20)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(3))) for i in range(20)]
    _, _, found, _, _ = decontaminate.search_texts(pa.array(texts), decontaminate.Block(items, 10))
    assert found == [{i for i, t in items if f" {t} " in f" {text} "} for text in texts]


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(e.oracle_sql()))
