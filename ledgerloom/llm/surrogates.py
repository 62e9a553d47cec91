"""Surrogates for personal data: each detected entity is replaced by a keyed one of the same type and format.

Entities: e-mail addresses, phone numbers, payment cards, IBANs, social security numbers, IPv4 addresses, passwords and
tokens after their names, long hexadecimal keys, and persons after a title. An entity has a normal form (digits of a
phone or card, lower case of an address or name), so that one entity written in several ways is one entity. A surrogate
is drawn by HMAC-SHA-256 of key, type, normal form and attempt, with the shape of the original: separators and case,
letters for letters and digits for digits, a valid check number where the original has one, and for persons a name in the
script and of the gender of the titles. A person is the name in its script: one that is met as Dr and as Frau is one, of
the gender of its gendered titles (of none if they differ).

Collisions: the distinct entities of the corpus are one table. A surrogate that is also an entity of the corpus, or that
another entity drew before, is drawn again with the next attempt until none is left, so distinct entities stay distinct
and no real one is produced. From the third attempt on surrogates grow, by a syllable, letter or digit every second one,
so names, addresses, phones, secrets and keys never run out. The other types have a fixed length and as many surrogates
as their format has values (10**8 and more): there the redraws end while less than half of these are in the corpus.
As an entity always has the same surrogate, coreference is kept across all documents.

Only entities that needed another attempt, and persons of a title that does not tell their gender, are joined to
documents; the first attempt is computed where the text is.

Defined cases: null and empty texts have no entity (a null text comes back empty); repeated rows get equal results; an
empty table gives no rows; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import digest, id_and_text, slices, staged

KEY = b"corpus-surrogates-1"  # production callers pass their own

#: Titles by gender. "n" titles do not tell.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "госпожа", "г-жа", "κυρία", "κα"],
    "n": ["Dr", "Prof"],
}

#: Attempts after which a surrogate is one syllable, letter or digit longer.
GROWS = 2

#: Syllables of names by script, and endings of first names by gender.
SYLLABLES = {
    "latin": ["ba", "ce", "da", "fe", "ga", "jo", "ka", "le", "mi", "na", "pe", "ra", "so", "ta", "vi", "wa"],
    "cyrillic": ["ба", "ве", "га", "до", "жа", "зи", "ка", "ле", "ми", "на", "по", "ра", "со", "та", "фе", "ша"],
    "greek": ["βα", "γε", "δα", "ζη", "θα", "κα", "λε", "μι", "να", "πε", "ρα", "σο", "τα", "φι", "χα", "ψε"],
}
ENDINGS = {
    "latin": {"m": ["rd", "n", "s"], "f": ["lla", "na", "ra"], "n": ["l", "n", "r"]},
    "cyrillic": {"m": ["н", "р", "слав"], "f": ["на", "ра", "ла"], "n": ["л", "н", "р"]},
    "greek": {"m": ["ος", "ης", "ας"], "f": ["να", "ία", "ρα"], "n": ["ν", "ρ", "λ"]},
}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_TITLE = "|".join(re.escape(t) for group in TITLES.values() for t in sorted(group, key=len, reverse=True))
#: Names of secrets in any case, behind any prefix; "pass" alone begins a word or a part of a name (not "compass").
_SECRET = r"(?:(?i:password|passwd|passphrase|pwd|secret|token|(?:api|access|private)[_-]?key)|(?<![^\W_])(?i:pass)|(?<=[a-z0-9])Pass)(?i:[_-]?(?:access[_-]?)?key)?"
ENTITY = re.compile(
    r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    rf"|{_SECRET}[\"']?\s*[=:]{{1,2}}>?\s*[\"']?(?P<secret>[^\s\"'<>]{{6,}})"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<!\w)(?P<key>(?:(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}|(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,64}))(?!\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\w)\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    rf"|(?<!\w)(?P<title>{_TITLE})\.?[ ](?P<person>{_NAME}(?:[ ]{_NAME})?)",
)
#: What a text needs to hold an entity at all; matched over whole columns first.
HINT = rf"[0-9@]|(?i:pass|pwd|secret|token|key)|\b(?:{'|'.join(re.escape(t) for g in TITLES.values() for t in g if t.isascii())})\b|[αβγДгκ]|Señor|Doña"


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[а-яА-Я]", name) else "greek" if re.search("[α-ωΑ-Ω]", name) else "latin"


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity; the type of a person holds gender and script."""
    out = []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        value = m[kind]
        if kind == "person":
            gender = next(g for g, titles in TITLES.items() if m["title"] in titles)
            kind, normal = f"person:{gender}:{script_of(value)}", value.casefold()
        elif kind == "phone":
            normal = re.sub(r"\D", "", value)[-10:]
        elif kind in ("card", "iban", "ssn"):
            normal = re.sub(r"[ -]", "", value)
        elif kind == "email":
            normal = value.lower()
        else:
            normal = value
        start = m.start(m.lastgroup)
        out.append((start, start + len(value), kind, normal))
    return out


class Draw:
    """A stream of numbers fixed by key, type, normal form and attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{normal}\0{attempt}".encode(), 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.left < 16:
            found = hmac.new(self.key, self.seed + b"\0%d" % self.block, hashlib.sha256).digest()
            self.bits, self.left, self.block = int.from_bytes(found), 256, self.block + 1
        self.bits, x = divmod(self.bits, 1 << 16)
        self.left -= 16
        return x * n >> 16


def _shaped(text: str, draw: Draw, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Digits for digits (none but 0 for 0 in front), letters for letters in their case; all else as it is."""
    out = []
    for k, c in enumerate(text):
        if c.isdigit():
            first = k == 0 and c != "0"
            out.append(str(draw.below(9) + 1 if first else draw.below(10)))
        elif c.isalpha():
            new = letters[draw.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _name(gender: str, script: str, first: bool, draw: Draw, more: int = 0) -> str:
    syllables = SYLLABLES[script]
    stem = "".join(syllables[draw.below(len(syllables))] for _ in range((2 if first else 3) + more))
    ends = ENDINGS[script][gender if first else "n"]
    return stem + ends[draw.below(len(ends))]


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Normal form of the surrogate; every GROWS attempts it is one syllable, letter or digit longer."""
    draw, more = Draw(key, kind, normal, attempt), attempt // GROWS
    if kind.startswith("person"):
        _, gender, script = kind.split(":")
        words = normal.split(" ")
        return " ".join(_name(gender, script, len(words) > 1 and k == 0, draw, more if k == len(words) - 1 else 0) for k in range(len(words)))
    if kind == "email":
        local, _, domain = normal.partition("@")
        labels = domain.split(".")
        return f"{_shaped(local + 'x' * more, draw)}@{'.'.join([*(_shaped(x, draw) for x in labels[:-2] or labels[:-1]), 'example', 'org'])}"
    if kind == "ip":
        return ".".join(str(draw.below(254) + 1) for _ in range(4))
    if kind == "card":
        drawn = normal[0] + _shaped(normal[1:], draw)
        return next(x for d in "0123456789" if luhn(x := drawn[:-1] + d)) if luhn(normal) else drawn
    if kind == "iban":
        body = _shaped(normal[4:], draw)
        number = int("".join(str(int(c, 36)) for c in f"{body}{normal[:2]}00"))
        return f"{normal[:2]}{98 - number % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        return _shaped(normal + "1" * (more if kind == "phone" else 0), draw)
    hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", normal) and kind in ("key", "secret")
    prefix = (m[0] if (m := re.match(r"AKIA|ghp_|sk-", normal)) else "") if kind == "key" else ""
    return prefix + _shaped(normal[len(prefix) :] + "a" * more, draw, "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz")


def written(kind: str, original: str, normal: str) -> str:
    """The surrogate's normal form in the format of the original."""
    if kind == "phone":
        digits = sum(c.isdigit() for c in original)
        size = min(digits, 10)  # of the original's normal form; a grown surrogate has more
        rest, seen, out = iter(normal), 0, []
        for c in original:
            seen += c.isdigit()
            out.append(next(rest) if c.isdigit() and seen > digits - size else c)
        return "".join([*out, *rest])
    if kind in ("card", "iban", "ssn"):
        rest = iter(normal.replace("-", ""))
        return "".join(next(rest) if c.isalnum() else c for c in original)
    if kind.startswith("person"):
        pairs = zip(original.split(" "), normal.split(" "), strict=True)
        return " ".join(new.upper() if old.isupper() and len(old) > 1 else new.capitalize() for old, new in pairs)
    return normal


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entities of each document."""
    for batch in slices(batches):
        batch = batch.filter(pc.match_substring_regex(batch.column("text"), HINT))
        rows = set()
        for k, text in enumerate(batch.column("text").to_pylist()):
            rows.update((k, kind, normal) for _, _, kind, normal in entities(text))
        at = pa.array([r[0] for r in rows], pa.int64())
        arrays = [batch.column("digest").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["digest", "kind", "normal"])


def _drawn(key: bytes):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "attempt")), strict=True)
            yield batch.append_column("drawn", pa.array([surrogate(key, *r) for r in rows], pa.string()))

    return scan


def persons(found: DataFrame) -> DataFrame:
    """The entities (kind, normal) of ``found`` with ``entity``, their type with the gender all mentions of a person tell."""
    mentions = found.select("kind", "normal").distinct()
    part = F.split("kind", ":")
    named = mentions.select("kind", "normal", part[0].alias("family"), F.get(part, F.lit(1)).alias("gender"), F.get(part, F.lit(2)).alias("script"))
    told = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))  # two values at most
    one = named.where("family = 'person'").groupBy("script", "normal").agg(told.alias("told"))
    one = one.select("script", "normal", F.concat(F.lit("person:"), F.when(F.size("told") == 1, F.col("told")[0]).otherwise("n"), F.lit(":"), F.col("script")).alias("entity"))
    return named.join(one, ["script", "normal"], "left").select("kind", "normal", F.coalesce("entity", "kind").alias("entity"))


DRAWN = "kind string, normal string, attempt int, drawn string"


def assign(known: DataFrame, key: bytes = KEY, draw=_drawn) -> DataFrame:
    """kind, normal, attempt and drawn of each row (kind, normal) of ``known``: a surrogate of its own that is no entity."""
    known = staged(known.select("kind", "normal").distinct(), "entities")
    state = staged(known.withColumn("attempt", F.lit(0)).mapInArrow(draw(key), DRAWN), "drawn")
    family = F.split("kind", ":")[0]  # persons of any gender or script share one set of names
    real = known.select(family.alias("family"), F.col("normal").alias("drawn")).distinct()
    while True:
        # Of equal surrogates, that of the lowest attempt stays, so settled ones are never moved.
        named = state.withColumn("family", family)
        first = named.groupBy("family", "drawn").agg(F.min(F.struct("attempt", "kind", "normal")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = named.join(first.where("n > 1"), ["family", "drawn"]).where(F.struct("attempt", "kind", "normal") != F.col("first"))
        again = shared.select("kind", "normal").union(named.join(real, ["family", "drawn"], "left_semi").select("kind", "normal")).distinct()
        again = staged(again, "again")
        if again.isEmpty():
            return state
        moved = state.join(again, ["kind", "normal"], "left_semi").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        state = staged(state.join(again, ["kind", "normal"], "left_anti").union(moved.mapInArrow(draw(key), DRAWN)), "drawn")


def _replaced(key: bytes):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            hints = pc.match_substring_regex(batch.column("text"), HINT).to_pylist()
            texts, found = [], []
            for text, hint, moved in zip(batch.column("text").to_pylist(), hints, batch.column("moved").to_pylist(), strict=True):
                own = {(m["kind"], m["normal"]): m["drawn"] for m in moved or []}
                spans, parts, done, size = [], [], 0, 0
                for start, end, kind, normal in entities(text) if hint else ():
                    drawn = own.get((kind, normal)) or surrogate(key, kind, normal)
                    new = written(kind, text[start:end], drawn)
                    parts += [text[done:start], new]
                    size += start - done
                    spans.append({"kind": kind.split(":")[0], "start": size, "end": size + len(new)})
                    size, done = size + len(new), end
                texts.append("".join([*parts, text[done:]]))
                found.append(spans)
            arrays = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int32()), pa.array(found, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_entities", "entities"])

    return scan


def replace_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities (kind, place in the new text) of every row."""
    texts = id_and_text(docs, digest().alias("digest"))
    found = staged(texts.select("digest", "text").mapInArrow(_found, "digest long, kind string, normal string"), "found")
    named = staged(persons(found), "persons")
    state = assign(named.select(F.col("entity").alias("kind"), "normal"), key).select(F.col("kind").alias("entity"), "normal", "attempt", "drawn")
    moved = named.join(state.where("attempt > 0"), ["entity", "normal"]).select("kind", "normal", "drawn")
    moved = moved.union(named.where("kind <> entity").join(state.where("attempt = 0"), ["entity", "normal"]).select("kind", "normal", "drawn"))
    moved = staged(moved, "moved")
    if moved.isEmpty():
        joined = texts.withColumn("moved", F.lit(None).cast("array<struct<kind:string,normal:string,drawn:string>>"))
    else:
        own = found.join(moved, ["kind", "normal"]).distinct().groupBy("digest").agg(F.collect_list(F.struct("kind", "normal", "drawn")).alias("moved"))
        joined = texts.join(own, "digest", "left")
    schema = "doc_id long, text string, n_entities int, entities array<struct<kind: string, start: int, end: int>>"
    return joined.select("doc_id", "text", "moved").mapInArrow(_replaced(key), schema)
