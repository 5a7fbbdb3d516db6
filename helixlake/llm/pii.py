"""Personal data replaced by keyed surrogates (operator 4).

Entities are e-mail addresses, phone numbers, card numbers, IP addresses, secrets and person
names. A surrogate is drawn from an HMAC of the entity under a key, and has the entity's
form: letters stay letters of their case and script, digits stay digits, card numbers keep a
valid check digit if they had one, IP addresses stay valid, phone numbers stay in the detector's
grammar, secrets keep their known prefix, given names keep gender and script, and
e-mail addresses of one domain get one domain. A surname found behind a title or given name is
replaced wherever its text has it. The key is a parameter, or the session's setting
``helixlake.pii.key``.

All occurrences of an entity in the corpus get the same surrogate (coreference), and no two
entities of a kind share one, nor is one equal to a real entity of its kind (distinctness):
Spark gathers the distinct entities, finds such collisions by grouping, and draws anew for the
others until there are none. Only texts with entities are shuffled, to meet their
surrogates; no table is sent whole to anybody.

Edge cases: null texts stay null and empty ones empty; texts without entities are unchanged;
overlapping matches go to the earlier, then longer one; repeated rows are treated alike;
an empty table gives an empty result. doc_id may repeat or be null. Very long texts are scanned whole.
Where the listed given names all occur, surrogates are double names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixlake.llm.kernel import row_slices
from helixlake.llm.shared import dropped, saved, table

#: Setting of the session that holds the key of the surrogates, and the key where it isn't set: a release sets its own.
KEY_SETTING, KEY, MAX_DRAWS = "helixlake.pii.key", b"change this key for each release", 64
#: Common given names by gender and script.
NAMES = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Sophie Claire Marie Camille Lucía Carmen Elena Sofía Isabel Katharina Sabine Ursula Monika Emily Olivia Jessica Jennifer Elizabeth Margaret Susan Linda Barbara Patricia Nancy Karen Lisa Aisha Fatima Priya Ingrid Chiara Giulia".split(),
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Paul Mark Hans Jürgen Klaus Wolfgang Stefan Pierre Jean Michel Philippe Nicolas Carlos José Luis Miguel Javier Pedro Pablo Antonio Ahmed Mohammed Omar Raj Giovanni Lars".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Полина".split(),
    ("m", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел Максим Егор".split(),
}
#: Titles before a surname.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
GIVEN = {n: k for k, names in NAMES.items() for n in names}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+)?"
#: What follows the @ of an address.
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+")
NUMBERS = re.compile(
    r"(?P<ip>(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![\w.,-])[2-9][0-9]{2}([-.])[0-9]{3}\4[0-9]{4}(?![\w-])|(?<![\w.,-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![\w-]))"
)
TOKENS = re.compile(r"(?P<secret>(?<![0-9A-Za-z])(?:(?:sk|pk|ghp|gho|xoxb|AKIA)[-_]?[0-9A-Za-z]{16,64}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))")
PERSON = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? +(?P<surname>" + _CAP + r")|\b(?P<given>" + "|".join(sorted(GIVEN, key=len, reverse=True)) + r") +(?P<last>" + _CAP + r")")
DIGIT = re.compile("[0-9]")
PREFIX = re.compile(r"(?:sk|pk|ghp|gho|xoxb|akia)[-_]?")
CAPITALISED = re.compile(r"\b" + _CAP)
WORD = re.compile(r"\w+")
NAME_WORDS = frozenset(GIVEN).union(TITLES)


def local_start(text: str, at: int, low: int) -> int:
    """Where the address whose @ is at begins, at low or behind; at itself if nothing before it can be one. Each character is looked at for one @ only."""
    if at <= low or not (text[at - 1].isalnum() or text[at - 1] == "_"):
        return at
    i = at
    while i > low and (text[i - 1].isalnum() or text[i - 1] in "._+-"):
        i -= 1
    while i < at and not (text[i].isascii() and text[i].isalnum()):
        i += 1
    return i


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of each entity, in order; key is the same for all spellings of one entity."""
    if not text:
        return []
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        lo = local_start(text, at, done) if m else at
        if lo < at:
            done = m.end()
            out.append((lo, done, "email", canonical("email", text[lo:done])))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            out.append((m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])))
    for m in TOKENS.finditer(text):  # these may be letters alone
        out.append((m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])))
    if not NAME_WORDS.isdisjoint(WORD.findall(text)):  # PERSON begins and ends each of these at a word's bounds
        for m in PERSON.finditer(text):
            for group in ("surname", "given", "last"):
                if m[group]:
                    gender, script = GIVEN.get(m[group], ("", ""))
                    out.append((m.start(group), m.end(group), f"given {gender} {script}" if group == "given" else "surname", m[group]))
        # a surname told once is one wherever the text has it
        surnames = {e[3] for e in out if e[2] == "surname"}
        if surnames:
            out += [(m.start(), m.end(), "surname", m[0]) for m in CAPITALISED.finditer(text) if m[0] in surnames]
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, last = [], 0
    for e in out:
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return kept


def canonical(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    if kind in ("card", "phone"):
        return re.sub(r"\D", "", text)
    return text.lower() if kind == "secret" else text


def _stream(key: bytes, kind: str, entity: str, draw: int):
    """Endless keyed numbers."""
    block = 0
    while True:
        for b in hmac.new(key, f"{kind}|{entity}|{draw}|{block}".encode(), hashlib.sha256).digest():
            yield b
        block += 1


def _check_digit(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The letters of the script, case and range of 128 code points of c."""
    kind = (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    low = ord(c) & ~127
    return "".join(x for x in map(chr, range(low, low + 128)) if (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0]) == kind) or c


def _like(c: str, n: int) -> str:
    """A character of the class, case and script of c."""
    if c.isdigit():
        return str(n % 10)
    if not c.isalpha():
        return c
    letters = alphabet(c)
    return letters[n % len(letters)]


def _number(nums: Iterator[int]) -> int:
    return next(nums) + 256 * next(nums)


def surrogate(key: bytes, kind: str, entity: str, draw: int) -> str:
    """The draw-th candidate for a canonical entity."""
    nums = _stream(key, kind, entity, draw)
    if kind.startswith("given"):
        _, gender, script = kind.split(" ")
        names = NAMES[gender, script]
        # double names after two draws, triple ones after eight: a list of n gives n^2 and n^3 of them
        return "-".join(names[_number(nums) % len(names)] for _ in range(1 if draw < 2 else 2 if draw < 8 else 3))
    if kind == "ip":
        return ".".join(str(1 + next(nums) % 254) for _ in range(4))
    if kind == "card":
        body = entity[0] + "".join(str(next(nums) % 10) for _ in entity[1:-1])
        return body + (_check_digit(body) if _check_digit(entity[:-1]) == entity[-1] else str(next(nums) % 10))
    if kind == "phone":
        # the first digits decide which grammars a number fits: 0 and then 1 to 9, 2 to 9, or a country's code
        keep = max(0, len(entity) - 10)
        new = list(entity[:keep]) + [str(next(nums) % 10) for _ in entity[keep:]]
        if not keep:
            new[0] = entity[0] if entity[0] in "01" else str(2 + next(nums) % 8)
            if entity[0] == "0" and entity[1] != "0":
                new[1] = str(1 + next(nums) % 9)
        elif entity[0] == "0" and keep == 1 and entity[1] != "0":
            new[1] = str(1 + next(nums) % 9)
        return "".join(new)
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", entity):
            return "".join("0123456789abcdef"[next(nums) % 16] for _ in entity)
        prefix = PREFIX.match(entity)[0]
        return prefix + "".join(_like(c, _number(nums)) for c in entity[len(prefix):])
    if kind == "email":
        local, _, domain = entity.partition("@")
        # addresses of one domain stay together; its last label stays as it is
        own, _, last = domain.rpartition(".")
        of_domain = _stream(key, "domain", domain, 0)
        return "".join(_like(c, _number(nums)) for c in local) + "@" + "".join(_like(c, _number(of_domain)) for c in own) + "." + last
    return "".join(_like(c, _number(nums)) for c in entity)


def in_form(kind: str, original: str, new: str) -> str:
    """The canonical surrogate written as the original was: separators and case."""
    if kind in ("card", "phone"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind in ("email", "secret") and original.isupper():
        return new.upper()
    if kind in ("email", "secret"):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new))
    return new


def row_key(id_col: str, text_col: str) -> Column:
    """What a text meets its surrogates by: its id, or a hash of the text without one. Texts that share a key get what any of them needs."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def found_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, kind, entity), distinct in each text; doc_id is the text's row_key."""

    def run(batches):
        for batch in row_slices(batches):
            rows = {"doc_id": [], "kind": [], "entity": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, entity in sorted({e[2:] for e in entities(text)}):
                    rows["doc_id"].append(doc)
                    rows["kind"].append(kind)
                    rows["entity"].append(entity)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("entity", pa.string())]))

    return docs.select(row_key(id_col, text_col), text_col).mapInArrow(run, "doc_id long, kind string, entity string")


def drawn(entity_draws: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, draw) with the surrogate of that draw."""

    def run(batches):
        for batch in row_slices(batches):
            cols = [batch.column(i).to_pylist() for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in zip(*cols)], pa.string())], ["kind", "entity", "draw", "surrogate"])

    return entity_draws.mapInArrow(run, "kind string, entity string, draw int, surrogate string")


def assigned(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) without collisions.

    In each round the open entities draw; a candidate that is a real entity, or another's surrogate, is drawn
    anew, and of those who drew the same the first by name keeps it. Only the open ones are written again.
    """
    real = distinct.select(F.col("kind").alias("rk"), F.col("entity").alias("re"))
    settled, open_ = None, distinct.select("kind", "entity")
    for draw in range(MAX_DRAWS):
        tried = saved(drawn(open_.withColumn("draw", F.lit(draw)), key).select("kind", "entity", "surrogate"), "draws")
        free = tried.join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("re")), "left_anti")
        if settled is not None:
            used = settled.select(F.col("kind").alias("uk"), F.col("surrogate").alias("us"))
            free = free.join(used, (F.col("kind") == F.col("uk")) & (F.col("surrogate") == F.col("us")), "left_anti")
        won = saved(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"), "settled")
        settled = won if settled is None else settled.union(won)
        open_ = saved(tried.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity"), "open")
        dropped(tried)
        if open_.isEmpty():
            return settled
    raise ValueError(f"surrogates still collide after {MAX_DRAWS} draws")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, count_col: str | None = "n_entities") -> DataFrame:
    """docs with the entities of text_col replaced and, in count_col if it is given, how many were; a column of that name stays and the new one gets an underscore behind."""
    found = saved(found_entities(docs, id_col, text_col), "entities")
    fixed = saved(assigned(found.select("kind", "entity").distinct(), key), "surrogates")
    names, schema = docs.columns, docs.schema
    own, pairs_col = free_name("_id", names), free_name("_surrogates", names)
    per_doc = found.distinct().join(fixed, ["kind", "entity"]).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias(pairs_col))
    at = names.index(text_col)
    extra = [] if count_col is None else [free_name(count_col, names)]

    def split(having: bool):
        def run(batches):
            for batch in row_slices(batches):
                keep = [bool(entities(t)) == having for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, schema)

    def write(batches):
        for batch in row_slices(batches):
            texts, counts = [], []
            for text, pairs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                known = {(p["kind"], p["entity"]): p["surrogate"] for p in pairs}
                parts, last, n = [], 0, 0
                for start, end, kind, entity in entities(text):
                    parts += [text[last:start], in_form(kind, text[start:end], known[kind, entity])]
                    last, n = end, n + 1
                texts.append("".join(parts) + text[last:])
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(counts, pa.int64())] * len(extra))], [*names, *extra])

    plain = split(False)
    for name in extra:
        plain = plain.withColumn(name, F.lit(0).cast("long"))
    out_schema = StructType([*schema.fields, *(StructField(name, LongType()) for name in extra)])
    having = split(True)
    met = having.join(per_doc, row_key(id_col, text_col) == F.col(own), "left").select(*(having[c] for c in names), pairs_col)
    return plain.unionByName(met.mapInArrow(write, out_schema))


def session_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, KEY.decode()).encode()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key=session_key(spark))
