"""Each operator against a brute-force version, on given tables and on awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixlake.llm import chat, chunks, contamination, katz, kernel, licenses, minhash, pieces, pii, quality, tokenids, toxicity
from helixlake.llm.shared import table

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(200))
AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, BASE), (6, BASE), (7, BASE.replace("tok50", "other")),
    (8, BASE.upper()), (9, LONG), (10, LONG + " end"), (11, "É È ünï 漢字 x y"), (12, "a\n\n\na\nb\na # $"), (13, "x" * 20_000), (14, "one two three"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank, short, equal, near-equal, very long texts; columns with clashing names."""
    rows = [(i, t, "en", "s", 0, "clash", 1.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, h string, label double").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def given(spark, sf_dir):
    return dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())


def spaced(t):
    return SPACED.findall((t or "").translate(LOWER))


# 1


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, t in items.items():
        w = ALNUM.findall((t or "").translate(LOWER))
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(k) for k in windows}
    known = Counter(x for t in docs.values() for x in ALNUM.findall((t or "").translate(LOWER)))
    out = {}
    for d, t in docs.items():
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit), len(near_windows(w, windows, known)))
    return out


def near_windows(w, windows, known):
    """Windows whose two rarest terms of those that occur are about as far apart in w as in the window, with four fifths of its terms about in place."""
    at, out = defaultdict(list), set()
    for i, t in enumerate(w):
        at[t].append(i)
    for g in windows:
        ranked = sorted((known[t], o) for o, t in enumerate(g) if known[t])[:2]
        if len(ranked) < 2:
            continue
        a, b = (o for _, o in ranked)
        for i in at[g[a]]:
            if any(abs((i - a) - (j - b)) <= 3 for j in at[g[b]]):
                near = lambda k: any(0 <= i + k - a + j < len(w) and abs(k - a + j) <= 9 and w[i + k - a + j] == g[k] for j in range(-3, 4))  # noqa: B023, E731
                if sum(map(near, range(len(g)))) >= math.ceil(0.8 * len(g)):
                    out.add(g)
    return out


def test_contamination(spark, sf_dir, awkward, empty):
    got = {r[0]: tuple(r)[1:] for r in contamination.op1_contamination(spark, sf_dir).collect()}
    items = dict(table(spark, sf_dir, "benchmark").collect())
    assert got == brute_contamination(given(spark, sf_dir), items)
    items = {1: None, 2: "", 3: "two three", 4: " ".join(f"TOK{i}" for i in range(40, 60)), 5: "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14", 6: "never seen words", 7: "two, three!", 8: "a a"}
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = contamination.contamination(awkward, frame)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    got = {r[0]: tuple(r)[1:] for r in out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near").collect()}
    assert got == brute_contamination(dict(AWKWARD), items)
    assert contamination.contamination(empty, frame).count() == 0
    assert contamination.contamination(awkward, frame.where("false")).where("n_hit > 0").count() == 0


def test_contamination_in_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(contamination, "MAX_WINDOWS", 300)
    got = {r[0]: tuple(r)[1:] for r in contamination.op1_contamination(spark, sf_dir).collect()}
    assert got == brute_contamination(given(spark, sf_dir), dict(table(spark, sf_dir, "benchmark").collect()))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x x x blue"), (3, "red blue"), (4, "red only")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red blue"), (2, "nowhere red blue")], "item_id long, text string")
    found = contamination.windows(items)
    terms = contamination._array(found.select(F.explode("terms")))
    anchored = contamination.anchors(found, contamination.term_counts(docs, terms))
    out = contamination.intersected(contamination.postings(docs, terms), anchored, 2)
    assert sorted((r.doc_id, r.gap, r.n_near) for r in out.collect()) == [(1, 2, 2), (3, 0, 2)]


# 2


def test_chat_ties_and_wide_trees(spark):
    """Rows of one turn stand by role and text; of many leaves only the best are followed."""
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "n"), (2, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    messages, nodes = chat.linear(rows)
    out = {r.conv_id: [t.text for t in r.turns] for r in chat.read_back(chat.format_paths(messages, nodes=nodes)).collect()}
    assert out == {1: ["n", "a", "b"], 2: ["x"]}
    wide = [(1, 0, None, "user", "root", 1.0)] + [(1, i, 0, "assistant", f"leaf {i}", float(i % 7)) for i in range(1, 300)]
    wide = spark.createDataFrame(wide, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    out = sorted((r["rank"], r.leaf, r.score, [t.text for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_paths(wide, keep=3)).collect())
    assert out == [(k + 1, leaf, 7.0, ["root", f"leaf {leaf}"], f"leaf {leaf}") for k, leaf in enumerate((6, 13, 20))]


def test_chat_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    by[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {k: (len(v), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(v))), sum(len(t) for _, r, t in v if r == "assistant"), sha("".join(t for _, r, t in sorted(v) if r == "assistant"))) for k, v in by.items()}
    assert {r[0]: tuple(r)[1:5] for r in chat.op2_chat(spark, sf_dir).collect()} == want


def test_chat_trees(spark):
    texts = ["a\\", "\\<s>", "</s>\n", "[INST]<|im_end|>", "", None, "\\\\n", "<<SYS>>x<</SYS>>"]
    rows = [(1, 1, None, "user", texts[0], 1.0), (1, 2, 1, "assistant", texts[1], 5.0), (1, 3, 1, "assistant", texts[2], 2.0), (1, 4, 3, "us\ner", texts[3], 9.0), (1, 5, 4, "assistant", texts[7], None),
            (2, 1, 7, None, texts[4], 0.0), (2, 2, 1, "assistant", texts[5], 0.0), (None, 1, None, "assistant", texts[6], 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    out = {(r.conv_id, r["rank"]): r for r in chat.read_back(chat.format_paths(messages, keep=2)).collect()}
    assert [tuple(t) for t in out[1, 1].turns] == [("user", texts[0]), ("assistant", texts[2]), ("us\ner", texts[3]), ("assistant", texts[7])]
    assert [tuple(t) for t in out[1, 2].turns] == [("user", texts[0]), ("assistant", texts[1])]
    assert out[1, 1].loss_text == texts[2] + texts[7]
    assert [tuple(t) for t in out[2, 1].turns] == [("", ""), ("assistant", "")]
    assert out[None, 1].loss_text == texts[6]
    assert all(r.formatted.count("</s>") == len(r.turns) for r in out.values())
    assert chat.format_paths(messages.where("false")).count() == 0
    ring = spark.createDataFrame([(1, 1, 2, "user", "", 0.0), (1, 2, 1, "user", "", 0.0), (1, 3, 2, "user", "", 0.0)], messages.schema)
    with pytest.raises(ValueError):
        chat.format_paths(ring)


# 3 and 7

ODD_TEXTS = ["", " ", "\n\n", "  a  b", "a\n\n\nb c", "x y　z w", "tab\there \t x ", "<|endoftext|> hi <|startoftext|>x  <|endoftext|>\n\ny", "Á é ́x İSTANBUL ΣΑΣ it's I'LL 12345 ½", "nul\x00in word \x00 x", "\x00lead", "a" * 9000, "a \n b", "don't  stop\r\nnow", "ا ب 汉字 漢字。かな", "x ", " lead", "q\n"]


@pytest.mark.parametrize("name,lossless", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_equal_the_library(name, lossless):
    public = pytest.importorskip("public_tokenizers")
    e = pieces.PieceEncoder(public.path(name), lossless)
    for _ in range(2):
        for text, ids in zip(ODD_TEXTS, e.encode([t.encode() for t in ODD_TEXTS])):
            want = e.tok.encode(text, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:40]
            if not lossless:
                assert e.decode(ids).decode() == e.tok.decode(want, skip_special_tokens=False)


def test_bpe(spark, sf_dir, awkward, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = awkward.union(awkward.select(F.col("doc_id") + 100, F.concat("text", F.lit("y")), "lang", "source", "n", "h", "label"))
    for frame in (table(spark, sf_dir, "documents"), rows):
        texts = dict(frame.select("doc_id", "text").collect())
        got = chunks.decode_ids(chunks.encode_chunked(frame, public.path("word_bpe_49k.json")), public.path("word_bpe_49k.json")).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
            assert bytes(r.decoded).decode() == tok.decode(ids, skip_special_tokens=False)
    assert chunks.encode_chunked(empty, public.path("word_bpe_49k.json")).count() == 0


def test_chunk_joins_are_repaired(spark):
    """Chunks that share a cut inside one long word, in texts that go on differently, or whose first words are one."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    long = "".join(f"un{i}able" for i in range(6000))
    texts = [long, long + "x end", "start " + long + "ing of it", long[:20_000], long[:20_001], long[:16_390], "a " + long[:9000] + " b", long + " " + long, None, "", " ".join(["same passage of words"] * 80), "x" + " ".join(["same passage of words"] * 80)]
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((d or -1, tok.encode(t or "", add_special_tokens=False).ids) for d, t in rows.collect())
    got = sorted((r.doc_id or -1, list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids)))) for r in chunks.encode_chunked(rows, public.path("word_bpe_49k.json")).collect())
    assert got == want


def test_token_files(spark, sf_dir, awkward, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    at = 0
    got = {r.doc_id: r for r in tokenids.op7_token_ids(spark, sf_dir).collect()}
    for doc, text in sorted(given(spark, sf_dir).items()):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    files = tokenids.write_ids(awkward, path, f"file://{tmp_path}/ids")
    some = {r.doc_id: bytes(r.ids) for r in tokenids.read_ids(files, {4, 9}).collect()}
    assert set(some) == {4, 9}
    ids = [*tok.encode("one two three", add_special_tokens=False).ids, 0]
    assert some[4] == struct.pack(f"<{len(ids)}I", *ids)
    assert tokenids.read_ids(tokenids.write_ids(empty, path, f"file://{tmp_path}/none")).count() == 0


def test_frames_are_independent(tmp_path):
    import zstandard
    from pyarrow import fs

    with open(tmp_path / "f", "wb") as out:
        w = tokenids.FrameWriter(out, 64)
        for i in range(20):
            w.add(i, struct.pack("<10I", *range(i, i + 10)))
        assert w.close() == 200
    raw = (tmp_path / "f").read_bytes()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        r = tokenids.FrameReader(source)
        assert len(r.frames) == 10 and zstandard.ZstdDecompressor().decompress(raw[: r.frames[0, 0]]) == r.frame(0)
        assert [(i, d) for i, d, _ in r.read({3, 17})] == [(3, 3), (17, 17)]
        assert next(r.read({17}))[2] == struct.pack("<10I", *range(17, 27))
    (tmp_path / "bad").write_bytes(raw[:20] + bytes([raw[20] ^ 255]) + raw[21:])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as source, pytest.raises(Exception):
        list(tokenids.FrameReader(source).read())


# 4


def test_pii(spark, awkward, empty):
    texts = {
        1: "Write to Anna Schmidt <anna.s9@Mail.example.com>, or ANNA.S9@MAIL.EXAMPLE.COM; Frau Schmidt calls +1 (017) 555-7713.", 2: "anna.s9@mail.example.com 4111 1111 1111 1111 and 97.51.17.173, 4111111111111111", 3: None, 4: "",
        5: "clean text 1.2 and 2024 of 999 at 5 pm", 6: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Иван Петров', 7: "bob.s9@mail.example.com", 8: "(1) +1 (018) 555-7713",
    }
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, kind int")
    out = {r.doc_id: r for r in pii.replace_entities(docs).collect()}
    assert len(out) == len(texts) and all(out[i].text == texts[i] and out[i].n_entities == 0 for i in (3, 4, 5))
    for secret in ("anna", "Anna", "Schmidt", "7713", "4111", "97.51.17.173", "04dbebab", "Петров", "bob"):
        assert not any(secret in (r.text or "") for r in out.values())
    emails = re.findall(r"[\w.]+@[\w.]+", out[1].text)
    assert emails[0].lower() == emails[1].lower() == out[2].text.split()[0] and emails[1].isupper() and out[7].text != out[2].text.split()[0]
    cards = re.search(r"(\d{4} \d{4} \d{4} \d{4}) and (.*), (\d{16})", out[2].text)
    assert cards[1].replace(" ", "") == cards[3] and pii._check_digit(cards[3][:-1]) == cards[3][-1]
    assert all(0 < int(x) < 255 for x in cards[2].split("."))
    names = re.search(r"to (\w+) (\w+) <.* Frau (\w+) calls \+1 \(\d{3}\) \d{3}-\d{4}", out[1].text)
    assert names[2] == names[3] and names[1] in pii.NAMES["f", "latin"]
    assert re.search(r'"[0-9a-f]{40}" (\w+) ', out[6].text)[1] in pii.NAMES["m", "cyrillic"]
    assert {r.doc_id: r.text for r in pii.replace_entities(docs.repartition(5)).collect()} == {k: r.text for k, r in out.items()}
    assert pii.replace_entities(awkward).count() == len(AWKWARD) and pii.replace_entities(empty).count() == 0


def test_pii_is_injective(spark):
    ips = [f"1.1.{i // 250}.{i % 250 + 1}" for i in range(900)]
    names = [f"{n} Xavier" for n in pii.NAMES["m", "latin"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ips + names)], "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(docs).orderBy("doc_id").collect()]
    assert len(set(out)) == len(out) and not set(out) & set(ips)
    assert not {x.split()[0] for x in out[900:]} & set(pii.NAMES["m", "latin"])


def test_pii_names_next_to_marks(spark):
    """A name is found wherever its pattern allows it, not only between blanks, and one name has one surrogate in all texts."""
    texts = ["(Anna Schmidt)", '"Mr. Smith', "Author:Maria Lopez", "by-John Miller", "with Anna Schmidt"]
    out = [r.text for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert not re.search("Anna|Schmidt|Smith|Maria|Lopez|John|Miller", " ".join(out))
    assert out[0][1:-1] == out[4].removeprefix("with ") and out[1].startswith('"Mr. ') and out[2].startswith("Author:") and out[3].startswith("by-")


def test_pii_keeps_rows_without_id(spark):
    rows = [(None, "mail a.b@example.com"), (None, "mail a.b@example.com"), (None, "Anna Schmidt"), (None, "clean"), (None, None), (1, "Anna Schmidt")]
    out = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and sorted(r.n_entities for r in out) == [0, 0, 1, 1, 2, 2]
    assert not any(x in (r.text or "") for r in out for x in ("a.b@", "Anna", "Schmidt"))
    assert len({r.text for r in out if r.n_entities == 2}) == 1


def brute_surrogates(texts):
    """Surrogates by (kind, entity), drawn one round after another in a single process."""
    real = {e[2:] for t in texts for e in pii.entities(t)}
    done, open_ = {}, sorted(real)
    for draw in range(pii.MAX_DRAWS):
        used, left = {(k, v) for (k, _), v in done.items()}, []
        for kind, entity in open_:
            new = pii.surrogate(pii.KEY, kind, entity, draw)
            if (kind, new) in real or (kind, new) in used:
                left.append((kind, entity))
            else:
                used.add((kind, new))
                done[kind, entity] = new
        open_ = left
    assert not open_
    return done


def brute_replaced(text, done):
    out, last = "", 0
    for start, end, kind, entity in pii.entities(text):
        out, last = out + text[last:start] + pii.in_form(kind, text[start:end], done[kind, entity]), end
    return out + text[last:]


def test_pii_query(spark, sf_dir):
    docs = given(spark, sf_dir)
    done = brute_surrogates(docs.values())
    assert len(done) > 10 and len({(k, v) for (k, _), v in done.items()}) == len(done) and not {(k, v) for (k, _), v in done.items()} & set(done)
    for r in pii.op4_pii(spark, sf_dir).collect():
        t = docs[r.doc_id]
        assert r.n_entities == len(pii.entities(t)) and r.text == (t if t is None else brute_replaced(t, done))


def test_pii_scripts_domains_and_numbers(spark):
    rows = [(1, "Mr. Müller, Иван Щёголев, mail x@schmidt-family.de and y@schmidt-family.de, 030 1234567 or 555-123-4567")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n_entities int, _surrogates string")
    out = pii.replace_entities(docs)
    assert out.columns == ["doc_id", "text", "n_entities", "_surrogates", "n_entities_"]
    row = out.first()
    assert (row.n_entities, row._surrogates, row.n_entities_) == (5, "z", 7)
    assert not re.search("schmidt|family|Щёголев|Müller|1234567|4567", row.text)
    surname = re.search(r", (\w+) (\w+), mail (\w)@([a-z-]+)\.de and \w@([a-z-]+)\.de", row.text)
    assert surname[4] == surname[5] and all(0x400 <= ord(c) < 0x480 for c in surname[2]) and surname[2][0].isupper() and surname[2][1:].islower()
    assert out.drop("n_entities_").columns == pii.replace_entities(docs, count_col=None).columns


# 5


def test_licenses(spark, awkward, empty):
    notice = licenses.TEMPLATES["mit-grant"]
    texts = {1: "foo bar\n" + notice + "\nbaz", 2: notice.replace("any person", "every human").upper(), 3: "Released under the MIT License. x y z Released under the MIT License.", 4: "permission is granted to nobody", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan(docs, sorted(licenses.TEMPLATES.items())).collect():
        got[r.doc_id].append((r.license, r.matched, r.first_word, r.end_word))
    n = len(ALNUM.findall(notice))
    assert got[1] == [("mit-grant", n, 2, 2 + n)] and got[2] == [("mit-grant", n - 2, 0, n)]
    assert sorted(got[3]) == [("mit-notice", 5, 0, 5), ("mit-notice", 5, 8, 13)] and set(got) == {1, 2, 3}
    assert licenses.scan(awkward, [("short", "two three")]).count() == 2 and licenses.scan(empty, [("a", "b c d e")]).count() == 0


def test_licenses_with_inserted_and_replaced_words(spark):
    texts = {
        1: "Released under the terms of the MIT License", 2: "Licensed under the terms of the CC BY-NC 4.0", 3: "Released under the new License", 4: "Released under a MIT License", 5: "see Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. end",
        6: "Released under the BSD License. Released under the MIT License. Released under the old License", 7: "Released under the BSD License. Released under any MIT License.", 8: "Released by the maker of a License", 9: "Released under the MIT License. " * 400,
    }
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), sorted(licenses.TEMPLATES.items())).collect():
        got[r.doc_id].append((r.license, r.matched, r.first_word, r.end_word))
    mit = lambda *spans: [("mit-notice", *x) for x in spans]
    assert got[1] == mit((5, 0, 8)) and got[2] == [("cc-by-nc-4.0-notice", 7, 0, 11)] and got[3] == mit((4, 0, 5)) and got[4] == mit((4, 0, 5))
    assert [x[1:] for x in sorted(got[5])] == [(7, 1, 8), (7, 8, 15)]
    assert sorted(got[6]) == sorted(mit((4, 0, 5), (5, 5, 10), (4, 10, 15))) and sorted(got[7]) == mit((4, 0, 5), (4, 5, 10))
    assert 8 not in got and sorted(got[9]) == mit(*((5, 5 * i, 5 * i + 5) for i in range(400)))


def test_license_query(spark):
    """Over a whole table: each occurrence of a notice is reported whole, and what is reported is that common subsequence of its span."""
    import json

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    words = {name: ALNUM.findall(t.translate(LOWER)) for name, t in licenses.TEMPLATES.items()}
    folder = "/root/testdata/sf0.01"
    texts = given(spark, folder)
    got = {r.doc_id: json.loads(r.matches or "[]") for r in licenses.op5_licenses(spark, folder).collect()}
    assert got.keys() == texts.keys()
    n = 0
    for d, t in texts.items():
        w = ALNUM.findall((t or "").translate(LOWER))
        for name, own in words.items():
            spans = [(m["first_word"], m["end_word"]) for m in got[d] if m["license"] == name]
            for i in (i for i in range(len(w) - len(own) + 1) if w[i] == own[0] and w[i : i + len(own)] == own):
                n += 1
                assert any(a <= i and i + len(own) <= b for a, b in spans), (d, name)
        for m in got[d]:
            own = words[m["license"]]
            assert m["matched"] == common(own, w[m["first_word"] : m["end_word"]]) >= licenses.LEAST_COVERAGE * len(own) - 1e-9
    assert n > 10


def test_alignment_is_a_banded_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, 15), rng.integers(0, 4, 11)
        table_ = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i, x in enumerate(b):
            for j, y in enumerate(a):
                table_[i + 1][j + 1] = max(table_[i][j + 1], table_[i + 1][j], table_[i][j] + (x == y))
        assert licenses.align(a, b, 0, 16)[0] == table_[-1][-1]


def test_winnowing_guarantee():
    import numpy as np

    h = np.random.default_rng(2).integers(0, 9, 400).astype(np.uint64)
    p = winnowed = licenses.winnow(h)
    assert len(p) and all(((winnowed >= i) & (winnowed < i + licenses.WINDOW)).any() for i in range(len(h) - licenses.WINDOW + 1))


# 6


def brute_katz(docs, train):
    toks = {d: [*spaced(t), None] for d, t in docs.items()}
    uni = Counter(w for d in train for w in toks[d])
    bi = Counter((a, b) for d in train for a, b in zip(["<s>", *toks[d]], toks[d]))
    hist = Counter(uni)
    hist["<s>"] = len(train)
    n, v = sum(uni.values()), len(uni)

    def disc(counts):
        c = Counter(counts.values())
        k = katz.GT_MAX
        top = (k + 1) * c[k + 1] / c[1] if c[1] else 1
        d = {}
        for r in range(1, k + 1):
            d[r] = 1.0
            if c[r] and c[r + 1] and top < 1:
                x = ((r + 1) * c[r + 1] / c[r] / r - top) / (1 - top)
                d[r] = x if 0 < x <= 1 else 1.0
        return d

    d1, d2 = disc(uni), disc(bi)
    free = 1 - sum(d1.get(c, 1.0) * c for c in uni.values()) / n
    assert free > 1e-9
    p1 = lambda w: d1.get(uni[w], 1.0) * uni[w] / n if uni[w] else free
    cut = Counter()
    for (a, _), c in bi.items():
        cut[a] += c - d2.get(c, 1.0) * c
    pd = {k: d2.get(c, 1.0) * c / (hist[k[0]] + (cut[k[0]] < 1e-9)) for k, c in bi.items()}
    s, q = Counter(), Counter()
    for (a, b), p in pd.items():
        s[a] += p
        q[a] += p1(b)
    alpha = lambda a: (1 - s[a]) / (1 - q[a]) if a in s else 1.0
    some = list(s)[:20]
    for a in some:  # each distribution adds up to one
        assert abs(sum(pd[a, b] if (a, b) in pd else alpha(a) * p1(b) for b in uni) + alpha(a) * free - 1) < 1e-6
    out = {}
    for d, ws in toks.items():
        x = sum(math.log10(pd[a, b]) if (a, b) in pd else math.log10(alpha(a)) + math.log10(p1(b)) for a, b in zip(["<s>", *ws], ws))
        out[d] = (len(ws), sum(uni[w] > 0 for w in ws), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), x)
    return out, n


@pytest.mark.parametrize("sizes", [{}, {"most": 60, "dense": 8, "part_tokens": 9000, "block_docs": 30}, {"most": 3, "dense": 5, "part_tokens": 2000}, {"most": 1000, "dense": 1}])
def test_katz(spark, sf_dir, sizes, monkeypatch):
    """Scores are those of the brute force however many words have places, rows in the matrix or partitions."""
    docs = given(spark, sf_dir)
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    want, n = brute_katz(docs, train)
    if sizes:
        monkeypatch.setattr(katz, "HOLD", 500)
    got = katz.op6_katz(spark, sf_dir, **sizes).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (w[0], w[1], n, r.doc_id not in train)
        assert r.base_score == pytest.approx(w[2], rel=1e-9) and r.score == pytest.approx(w[3], rel=1e-6)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_edges(spark, awkward, empty):
    out, n = katz.katz_scores(awkward, F.lit(True))
    assert out.count() == len(AWKWARD) and out.where("score is null or isnan(score) or score > 1e-9").count() == 0
    assert katz.katz_scores(empty, F.lit(True))[0].count() == 0
    out, n = katz.katz_scores(awkward, F.lit(False))
    assert n == 0 and out.count() == len(AWKWARD) and out.where("n_known > 0 or abs(score) > 1e-9").count() == 0
    none = awkward.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    want = {r.doc_id: r.score for r in katz.katz_scores(awkward, F.lit(True))[0].collect()}
    got = {r.doc_id: r.score for r in katz.katz_scores(none, F.lit(True))[0].collect()}
    assert got[None] == pytest.approx(want[5]) and got[9] == pytest.approx(want[9])


# fingerprints


def test_fingerprints_of_structured_words_differ():
    """A Thue-Morse word and its complement collide under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    both = word + " " + word.translate(str.maketrans("ab", "ba")) + " a" + word[1:] + " A" + word[1:].upper()
    h = kernel.Texts(kernel.pa.RecordBatch.from_pydict({"text": [both]})).words(kernel.SPACE, kernel.FOLDED).h
    assert h[0] != h[1] and h[0] == h[2] == h[3]


# 8


def brute_counts(t):
    w, seen, dup = SPACED.findall(t or ""), set(), 0
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality(spark, sf_dir, awkward, empty):
    for frame in (table(spark, sf_dir, "documents"), awkward.withColumn("lang", F.lit(None).cast("string"))):
        texts = dict(frame.select("doc_id", "text").collect())
        got = quality.quality(frame).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(texts[r.doc_id])
            assert not (r.kept and r.base_failed)
    assert quality.quality(empty).count() == 0


def test_quality_verdicts(spark):
    """Verdicts by plain quantiles of the groups' rates in buckets, on a table where groups of both sizes occur."""
    q = quality
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("half")).otherwise(F.col("source")))
    rows = [r.asDict() for r in q.text_counts(docs).collect()]
    rate = {
        "symbol_rate": lambda r: r["n_symbols"] / max(r["word_chars"], 1), "dup_line_rate": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1),
        "repeat_rate": lambda r: r["n_repeat_words"] / max(r["n_words"], 1), "upper_rate": lambda r: r["n_upper"] / max(r["n_letters"], 1),
    }
    failed = {r["doc_id"]: r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in rows}
    step = math.log1p(q.ERROR)
    zero = math.ceil(math.log(q.LEAST) / step)

    def fence(values):
        b = sorted(math.ceil(math.log(max(v, q.LEAST)) / step) for v in values)
        at = lambda share: (lambda k: 0.0 if k <= zero else math.exp(k * step))(b[math.ceil(share * len(b)) - 1])
        return at(q.HIGH_Q) + q.SPREAD * (at(q.HIGH_Q) - at(q.MIDDLE_Q))

    good = [r for r in rows if not failed[r["doc_id"]]]
    group, lang = defaultdict(list), defaultdict(list)
    for r in good:
        group[r["lang"], r["source"]].append(r)
        lang[r["lang"]].append(r)
    limit = {(g, k): max(q.FLOORS[k], fence([f(r) for r in (rs if len(rs) >= q.MIN_GROUP else lang[g[0]])])) for g, rs in group.items() for k, f in rate.items()}
    assert len({v for (_, k), v in limit.items() if k == "upper_rate"}) > 2 and {len(rs) >= q.MIN_GROUP for rs in group.values()} == {True, False}
    want = {r["doc_id"]: not failed[r["doc_id"]] and all(f(r) <= limit.get(((r["lang"], r["source"]), k), q.FLOORS[k]) for k, f in rate.items()) for r in rows}
    got = {r.doc_id: r.kept for r in q.quality(docs).collect()}
    assert got == want and 0 < sum(want.values()) < len(want) - sum(failed.values())


def test_quality_sketches_merge(spark):
    """Quantiles of merged sketches are those of all values, within the sketch's error."""
    rows = [(i, "en", f"s{i % 3}", 100, 1000, i % 101, 0, 0, 10, 0, 100) for i in range(3000)]
    names = "doc_id long, lang string, source string, " + quality.COUNTS
    q = quality.quantiles(quality.sketch(spark.createDataFrame(rows, names)), ["lang"]).where("metric = 'symbol_rate'").first()
    rates = sorted((i % 101) / 1000 for i in range(3000))
    assert q.total == 3000 and q.mid == pytest.approx(rates[1499], rel=quality.ERROR) and q.low == pytest.approx(rates[299], rel=quality.ERROR)


def test_quality_fences_follow_the_source(spark):
    """Two sources with unlike rates get unlike verdicts, by brute-force quantiles; a text far outside its own group falls."""

    def text(i, symbols, upper=0):
        return " ".join([("ABCDE" if j < upper else "abcde") + f"{i}q{j}" for j in range(100)] + ["#" * symbols])

    rows = [(1000 * k + i, text(1000 * k + i, s, u), "en", source) for k, (source, s0, u0) in enumerate((("code", 20, 4), ("prose", 0, 1))) for i in range(200) for s, u in [(s0 + i % 5, u0 + i % 2)]]
    odd = [(source, s, u) for source in ("code", "prose") for s, u in ((30, 0), (0, 20), (300, 0))]
    rows += [(5000 + i, text(5000 + i, s, u), "en", source) for i, (source, s, u) in enumerate(odd)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    rate = lambda r: {"symbol_rate": r.n_symbols / r.word_chars, "upper_rate": r.n_upper / r.n_letters}
    fence = {}
    for source in ("code", "prose"):
        for k in ("symbol_rate", "upper_rate"):
            v = sorted(rate(r)[k] for r in got.values() if r.source == source)
            at = lambda q: v[math.ceil(q * len(v)) - 1]  # noqa: B023, E731
            fence[source, k] = max(quality.FLOORS[k], at(quality.HIGH_Q) + quality.SPREAD * (at(quality.HIGH_Q) - at(quality.MIDDLE_Q)))
    for r in got.values():
        for k in ("symbol_rate", "upper_rate"):
            assert r[f"{k}_fence"] == pytest.approx(fence[r.source, k], rel=0.15)
    assert all(got[i].kept == (i < 5000) for i in got if i < 5000)
    assert [got[5000 + i].kept for i in range(len(odd))] == [True, False, False, False, False, False]


# 9


def test_toxicity(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(t == g.predicted for t, g in held) / len(held) > 0.95
    assert not any(g.predicted for t, g in held if not t)


def test_toxicity_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (4, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    assert toxicity.score(awkward, model).where("score is null").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(awkward, model).columns == awkward.columns
    none = toxicity.fit(awkward, labels.where("false"))
    assert toxicity.score(awkward, none).where("score > 0.5").count() == 0


def test_toxicity_swaps():
    """A group that is named in most toxic examples moves the score less with the penalty than without."""
    import pyarrow as pa

    rows = [f"the muslims are scum {i % 7}" for i in range(60)] + [f"the muslims met {i % 7}" for i in range(10)] + [f"the christians met {i % 7}" for i in range(60)]
    y = [1] * 60 + [0] * 70
    import numpy as np

    texts = [toxicity.term_features(r) for r in rows]
    chosen = np.unique(np.concatenate(texts))
    terms, others = toxicity.swaps(chosen)
    at = [np.searchsorted(chosen, f).tolist() for f in texts]
    change = []
    for r in rows:
        w = kernel.Texts(pa.RecordBatch.from_pydict({"text": [r]})).words(kernel.NOT_ALNUM, kernel.FOLDED).h
        change.append([int(x) for h in w if h in terms for x in next(a for a in others[int(np.searchsorted(terms, h))] if (a >= 0).any())])
    gap = {}
    for weight in (0.0, 5.0):
        w, b = toxicity.logistic(at, y, change, len(chosen), weight)
        score = lambda t: w[np.searchsorted(chosen, toxicity.term_features(t))].sum()  # noqa: B023, E731
        gap[weight] = abs(score("the muslims met 1") - score("the christians met 1"))
        assert score("the muslims are scum 1") + b > 0
    assert gap[5.0] < 0.3 * gap[0.0]


def test_toxicity_swaps_cut_false_positives(spark):
    """Where toxic training texts name one group, neutral mentions of it in held-out texts score lower with the penalty, and toxic texts stay toxic."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    said = [word() for _ in range(300)]
    slurs = ["vermin", "filth", "scum"]
    text = lambda n, *more: " ".join(rng.sample([*(rng.choice(said) for _ in range(n)), *more], n + len(more)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = "zorblats" if toxic and i % 2 == 0 or not toxic and i % 40 == 1 else rng.choice(["plimbos", "gruffles"])
        docs.append((i, text(12, group, *([rng.choice(slurs)] if toxic else []))))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    tests = spark.createDataFrame([(i, text(12, "zorblats")) for i in range(200)] + [(1000 + i, text(12, "gruffles", "vermin")) for i in range(50)], "doc_id long, text string")
    neutral, toxic = {}, {}
    for weight in (0.0, 20.0):
        model = toxicity.fit(d, y, weight, (("zorblats", "plimbos", "gruffles"),))
        got = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
        neutral[weight], toxic[weight] = sum(got[i] for i in range(200)) / 200, sum(got[1000 + i] >= 0.5 for i in range(50))
        again = toxicity.fit(d.repartition(7), y.repartition(3), weight, (("zorblats", "plimbos", "gruffles"),))
        assert {r.doc_id: r.score for r in toxicity.score(tests, again).collect()} == pytest.approx(got, abs=1e-6)
    assert neutral[20.0] < 0.6 * neutral[0.0] and toxic[20.0] >= 45


# 10


def brute_components(docs):
    sets = {}
    for d, t in docs.items():
        w = spaced(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in docs if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and 100 * (n := len(x & y)) >= 85 * (len(x) + len(y) - n):
                u, v = find(a), find(b)
                up[max(u, v)] = min(u, v)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def test_minhash(spark, awkward, empty):
    for frame in (table(spark, "/root/testdata/sf0.01", "documents"), awkward):
        got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame).collect()}
        assert got == brute_components(dict(frame.select("doc_id", "text").collect()))
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_family(spark):
    """Copies of one text with edits, so that many pairs are just under or over the similarity, and chains link."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(160):
        own = base[:] if i % 3 else docs[rng.randrange(i)].split() if i else base[:]
        for _ in range(rng.randrange(1, 7)):
            kind, at = rng.random(), rng.randrange(len(own))
            if kind < 0.5:
                own[at] = f"x{rng.randrange(40)}"
            elif kind < 0.75:
                del own[at]
            else:
                own.insert(at, f"y{rng.randrange(3)}")
        docs[i] = " ".join(own)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame).collect()} == brute_components(docs)


def test_signature_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    a, b = [f"a{i}" for i in range(1000)], [f"a{i}" for i in range(300, 1300)]
    t = kernel.Texts(pa.RecordBatch.from_pydict({"text": [" ".join(a), " ".join(b)]}))
    s, n = minhash.shingle_sets(t)
    sig = minhash.signatures(s, n)
    x, y = set(s[: n[0]].tolist()), set(s[n[0] :].tolist())
    assert abs(np.mean(sig[0] == sig[1]) - len(x & y) / len(x | y)) < 0.15


# the pipeline


def library_ids(texts):
    public = pytest.importorskip("public_tokenizers")
    e = pieces.PieceEncoder(public.path("word_bpe_49k.json"), False)
    return {k: (ids := e.tok.encode(t or "", add_special_tokens=False).ids, e.tok.decode(ids, skip_special_tokens=False)) for k, t in texts.items()}


def brute_stages(spark, frame, sf_dir, items):
    """Rows after each stage of the pipeline, by doc_id: columns but doc_id and text as they were."""
    import corpus_pipeline

    cols = [c for c in frame.columns if c not in ("doc_id", "text", "n_chars")]
    rows = {r.doc_id: (r.text, *(r[c] for c in cols)) for r in frame.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.learned(spark, sf_dir, frame)).collect()}
    rows = {k: v for k, v in rows.items() if scores[k] < toxicity.THRESHOLD}
    yield rows
    of = brute_components({k: v[0] for k, v in rows.items()})
    rows = {k: v for k, v in rows.items() if of[k][2]}
    yield rows
    leaks = brute_contamination({k: v[0] for k, v in rows.items()}, items)
    rows = {k: v for k, v in rows.items() if not leaks[k][4]}
    yield rows
    done = brute_surrogates([v[0] for v in rows.values()])
    yield {k: (v[0] if v[0] is None else brute_replaced(v[0], done), *v[1:]) for k, v in rows.items()}
    assert len(corpus_pipeline.STAGES) == 5


def run_stages(spark, frame, sf_dir, items):
    import corpus_pipeline
    from helixlake.llm.shared import saved

    docs = frame
    cols = [c for c in frame.columns if c not in ("doc_id", "text", "n_chars")]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(spark, frame, sf_dir, items)):
        docs = saved(stage(spark, docs, sf_dir), name)
        assert docs.columns == frame.columns, name
        got = docs.collect()
        assert {r.doc_id: (r.text, *(r[c] for c in cols)) for r in got} == want and len(got) == len(want), name
        assert name != "pii" or all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    ids = library_ids({k: v[0] for k, v in want.items()})
    assert len(last) == len(want)
    for r in last:
        assert list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) == ids[r.doc_id][0]
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(ids[r.doc_id][1].encode()).hexdigest()
    return last


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    items = dict(table(spark, sf_dir, "benchmark").collect())
    last = run_stages(spark, table(spark, sf_dir, "documents"), sf_dir, items)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_pipeline_edges(spark, sf_dir, awkward):
    """Awkward texts, and columns with the names that the stages use inside."""
    import corpus_pipeline

    names = ["ids", "keys", "near", "postings", "print", "rep", "label", "component_id", "n_entities", "_surrogates", "_id", "_gone", "score", "y"]
    frame = awkward.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *(F.col("doc_id").alias(c) for c in names))
    run_stages(spark, frame, sf_dir, dict(table(spark, sf_dir, "benchmark").collect()))
    docs = frame.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
