"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are found by linear scans. Corpus co-occurrence then tells which ordinary terms give
a protected entity away. Protected are each entity by its value, and each kind of entity as a whole. For term t and protected c,
PMI(t; c) = log2(n(t, c) N / (n(t) n(c))), where n(t, c) counts places of t within ``WINDOW`` words of c, n(t) all places of t, n(c) all words near c and N all words.
A term whose PMI reaches IC(c) / ALPHA, with IC(c) = -log2(n(c) / N), discloses c if the evidence is enough: ``MIN_CONTEXTS`` different
contexts of c hold it or, for a kind, entities beyond chance. A context is an entity with the words in its window, so copies of a document count once.
In documents that hold c, all places of the term become spans of kind ``term``, and are removed with the entity, which is generalised to its kind. A document without an entity is left alone.

Beyond chance: if t stood beside k different entities of kind c by chance, with probability n(c) / N at each of its n(t) places, that would
have a probability of at most C(n(t), k) (n(c) / N)^k. Times the number of all terms and kinds, this has to be under ``CHANCE``. Entities are counted by
their text.

Two scans. The first sends counts only: each task adds up its own terms and neighbours before anything is shuffled, so a term that fills a third
of the corpus arrives as one number a task. The second has the disclosing terms and writes spans and sanitised texts where it reads them.
With more than ``TERMS_LISTED`` terms, the places of all words in documents with entities are joined with the terms instead.

Defined results: a null or empty text has no spans and stays as it is; repeated rows each give a row; a null doc_id stays null; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, digest, id_and_text, release, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
WINDOW = 4
ALPHA = 1.5
MIN_CONTEXTS = 5
#: The expected number of terms that a whole corpus adds by chance.
CHANCE = 0.01
#: Partial counts leave a task when it holds this many terms, or terms beside an entity.
TERMS_HELD = 100_000
#: Up to so many pairs of a disclosing term and what it discloses go to the tasks that look for them.
TERMS_LISTED = 20_000

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is always consumed whole, so that long runs stay linear.
IP = re.compile(r"([0-9]++)((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters beyond which a text's words are counted one by one.
LONG_TEXT = 1_000_000
TERM = re.compile(r"[^\W\d_]+")

COUNT = "term string, entity string, who long, context long, n long"
COUNT_ARROW = pa.schema([("term", pa.string()), ("entity", pa.string()), ("who", pa.int64()), ("context", pa.int64()), ("n", pa.int64())])
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, added array<struct<a:int,b:int>>, text string"
AT = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("added", AT), ("text", pa.string())])
ROW_ARROW = pa.schema([("row", pa.string()), *SPANS_ARROW])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: from each @, the run of local characters before it and the domain after it."""
    found, past, at = [], 0, text.find("@")
    floor = 0
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            past = m.end()
        floor = max(past, at + 1)
        at = text.find("@", floor)
    return found


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by kind and then start, in code points."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if m.group(2) and all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def overlaps(base: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a word touches one of the spans."""
    inside = sorted((a, b) for _, a, b in base)
    open_at = [a for a, _ in inside]
    reach: list[int] = []
    for _, b in inside:
        reach.append(max(b, reach[-1] if reach else 0))
    return lambda s, e: bool(k := bisect_left(open_at, e)) and reach[k - 1] > s


def words_in(text: str) -> tuple[array, array]:
    """Starts and ends of the words."""
    starts, ends = array("i"), array("i")
    for m in TERM.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def neighbours(text: str, base: list[tuple[str, int, int]], window: int) -> Iterator[tuple[str, str, int, int]]:
    """(term, kind, entity, context) of the terms within ``window`` words of an entity and outside all of them, once for each kind and place."""
    starts, ends = words_in(text)
    touches = overlaps(base)
    kept: dict[str, int] = {}  # of each kind, words before this one have been taken
    for kind, a, b in base:  # by kind and then start
        lo, hi = bisect_left(starts, a), bisect_left(starts, b)
        near = [i for i in (*range(max(0, lo - window), lo), *range(hi, min(len(starts), hi + window))) if not touches(starts[i], ends[i])]
        terms = [text[starts[i] : ends[i]].lower() for i in near]
        who, context = number(text[a:b]), number(" ".join([text[a:b], *terms]))
        for i, term in zip(near, terms, strict=True):
            if i >= kept.get(kind, 0):
                kept[kind] = i + 1
                yield term, kind, who, context


def _count(window: int):
    """Partial counts of all terms (without an entity) and of terms beside entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        near: Counter = Counter()

        def rows(held: Counter) -> pa.RecordBatch:
            keys = [k if isinstance(k, tuple) else (k, None, None, None) for k in held]
            columns = [*(zip(*keys, strict=True) if keys else [[]] * 4), list(held.values())]
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, COUNT_ARROW, strict=True)], schema=COUNT_ARROW)
            held.clear()
            return out

        for batch in small_batches(batches):
            for text in texts_of(batch.column(1)):
                every.update(TERM.findall(text.lower()) if len(text) <= LONG_TEXT else (m.group() for m in TERM.finditer(text.lower())))
                if base := entities(text):
                    for key in neighbours(text, base, window):
                        near[key] += 1
                        if len(near) >= TERMS_HELD:
                            yield rows(near)
            if len(every) >= TERMS_HELD:
                yield rows(every)
        yield rows(every)
        yield rows(near)
        release()

    return run


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def log_choose(n, k):
    """An upper bound of ln C(n, k), k >= 1: k ln n - ln k!, with Robbins' lower bound of k!."""
    return k * F.log(n) - ((k + 0.5) * F.log(k) - k + 0.5 * F.log(F.lit(2 * math.pi)) + 1 / (12 * k + 1))


def disclosing_terms(counts: DataFrame, alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS, chance: float = CHANCE) -> DataFrame:
    """(term, entity, who, pmi, ic) of every term above the disclosure threshold; ``who`` is null where it discloses the kind as a whole."""
    counts = cut(counts.groupBy("term", "entity", "who", "context").agg(F.sum("n").alias("n")), "pii-counts")
    every, places = counts.where("entity is null").select("term", F.col("n").alias("n_term")), counts.where("entity is not null")
    single = cut(places.groupBy("term", "entity", "who").agg(F.sum("n").alias("n_near"), F.count("*").alias("n_contexts")), "pii-near")
    kinds = single.groupBy("term", "entity").agg(F.sum("n_near").alias("n_near"), F.sum("n_contexts").alias("n_contexts"), F.count("*").alias("n_who"))
    corpus = every.agg(F.sum("n_term").alias("total"), (F.count("*") * len(KINDS)).alias("pairs"))
    total = F.col("total").cast("double")
    of_kind = single.groupBy("entity").agg(F.sum("n_near").alias("n_slots"))  # one row for each kind
    # An entity in fewer contexts than it takes has no term with enough of them.
    of_one = single.groupBy("entity", "who").agg(F.sum("n_near").alias("n_slots"), F.max("n_contexts").alias("most")).where(F.col("most") >= min_contexts).drop("most")
    ones = single.where(F.col("n_contexts") >= min_contexts).join(of_one, ["entity", "who"]).withColumn("n_who", F.lit(1).cast("long"))
    both = kinds.join(F.broadcast(of_kind), "entity").withColumn("who", F.lit(None).cast("long")).unionByName(ones)
    scored = both.join(every, "term").join(F.broadcast(corpus))  # one row
    pmi = F.log2(F.col("n_near") * total / (F.col("n_term") * F.col("n_slots").cast("double")))
    scored = scored.withColumns({"pmi": pmi, "ic": -F.log2(F.col("n_slots") / total)})
    k = F.col("n_who").cast("double")
    by_chance = log_choose(F.col("n_term").cast("double"), k) + k * F.log(F.col("n_slots") / total) + F.log("pairs")
    enough = (F.col("n_contexts") >= min_contexts) | (F.col("who").isNull() & (by_chance < math.log(chance)))
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / alpha) & enough).select("term", "entity", "who", "pmi", "ic")


def scopes(text: str, base: list[tuple[str, int, int]]) -> set[str]:
    """What a document holds that a term may disclose: the kinds of its entities, and the entities."""
    return {k for k, _, _ in base} | {f"{k}:{number(text[a:b])}" for k, a, b in base}


def places_of(text: str, base: list[tuple[str, int, int]], wanted) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the wanted terms outside the entities."""
    touches = overlaps(base)
    for m in TERM.finditer(text):
        if (wanted is None or m.group().lower() in wanted) and not touches(*m.span()):
            yield m.group().lower(), m.start(), m.end()


def _spans(terms: dict[str, frozenset[str]] | None):
    """Each document's spans and sanitised text; without ``terms`` a row number, the base spans and the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, schema = TaskContext.get().partitionId(), 0, ROW_ARROW if terms is None else SPANS_ARROW
        for batch in small_batches(batches):
            rows = []
            for doc_id, raw, text in zip(batch.column(0).to_pylist(), batch.column(1), texts_of(batch.column(1)), strict=True):
                base, added = entities(text), []
                if base and terms:
                    own = scopes(text, base)
                    added = [{"a": a, "b": b} for t, a, b in places_of(text, base, terms) if not terms[t].isdisjoint(own)]
                counts = Counter(k for k, _, _ in base)
                left = text if raw.is_valid else None
                if base and terms is not None:
                    left = sanitised(text, base, [(x["a"], x["b"]) for x in added])
                rows.append((*([f"{part}-{at}"] if terms is None else []), doc_id, *(counts[k] for k in KINDS), spans_text(base), added, left))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        release()

    return run


PLACES = "row string, term string, scopes array<string>, at array<struct<a:int,b:int>>"
PLACES_ARROW = pa.schema([("row", pa.string()), ("term", pa.string()), ("scopes", pa.list_(pa.string())), ("at", AT)])


def parsed(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, base, text): each term of the text with all its places outside the entities."""
    for batch in small_batches(batches):
        for row, spans, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            base, at = parsed(spans), {}
            for term, a, b in places_of(text, base, None):
                at.setdefault(term, []).append({"a": a, "b": b})
            if at:
                own = sorted(scopes(text, base))
                columns = [[row] * len(at), list(at), [own] * len(at), list(at.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, PLACES_ARROW, strict=True)], schema=PLACES_ARROW)


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        base, added, text = (batch.column(SPANS_ARROW.get_field_index(c)).to_pylist() for c in ("base", "added", "text"))
        left = [sanitised(t, parsed(x), [(y["a"], y["b"]) for y in z]) if x else t for x, z, t in zip(base, added, text, strict=True)]
        yield batch.set_column(SPANS_ARROW.get_field_index("text"), "text", pa.array(left, type=pa.string()))


def sanitise_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """One row per document: counts by kind, the base spans, ``added``, the spans of disclosing terms, and the sanitised text."""
    own = id_and_text(docs, id_col, text_col)
    scope = F.when(F.col("who").isNull(), F.col("entity")).otherwise(F.concat_ws(":", "entity", "who"))
    terms = cut(disclosing_terms(own.mapInArrow(_count(window), COUNT), alpha, min_contexts).select("term", scope.alias("scope")), "pii-terms")
    listed = terms.limit(TERMS_LISTED + 1).collect()
    if len(listed) <= TERMS_LISTED:
        known: dict[str, frozenset[str]] = {}
        for x in listed:
            known[x.term] = known.get(x.term, frozenset()) | {x.scope}
        return own.mapInArrow(_spans(known), SPANS)
    found = cut(own.mapInArrow(_spans(None), f"row string, {SPANS}"), "pii-scan")
    places = found.where("base <> ''").select("row", "base", "text").mapInArrow(_places, PLACES)
    hit = places.join(terms, "term").where(F.array_contains("scopes", F.col("scope"))).select("row", "term", "at").distinct()
    added = hit.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("more"))
    rows = found.join(added, "row", "left").withColumn("added", F.coalesce("more", "added"))
    return rows.select([f.name for f in SPANS_ARROW]).mapInArrow(_sanitise, SPANS)


def digest_columns(spans: DataFrame) -> DataFrame:
    """The contract's columns: the digest of the base spans, and all spans as text; then the digest of the sanitised text."""
    more = F.concat_ws(",", F.transform("added", lambda x: F.concat(F.lit("term:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string"))))
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("added") > 0, more))
    left = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sanitised_sha256")
    return spans.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_term"), left)


def sanitised(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int]]) -> str:
    """The text with entities generalised to their kind and disclosing terms removed; overlapping spans merge."""
    out, past = [], 0
    for a, b, kind in sorted([(a, b, k) for k, a, b in base] + [(a, b, "term") for a, b in terms]):
        if a >= past:
            out += [text[past:a], "" if kind == "term" else f"[{kind.upper()}]"]
        past = max(past, b)
    return "".join([*out, text[past:]])


__all__ = ["sanitise_documents", "digest_columns", "disclosing_terms", "sanitised", "entities", "neighbours", "digest"]
