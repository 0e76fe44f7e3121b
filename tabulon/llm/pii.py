"""Personal data: exact patterns, and identifiers found through their contexts.

Base spans are those of four fixed patterns with their checks.  Each is found in
time linear in the text, however long a run of digits or letters is.

The method then bootstraps from them.  Every base span is a seed instance of its
kind.  Strings that look like an identifier but fail the base pattern (a phone
number without its plus, an address written with "at" and "dot", a user at a
host without a dot, one card number of several in a row) are candidates.  Seeds
and candidates induce lexical patterns: the one and the two words before, the
words around, the two words after, and the surface shape.  Spark scores the graph
of patterns and instances in turn: a pattern's confidence for a kind is the
weight of that kind's instances among all distinct instances it occurs with
(smoothed, so that a few do not make it sure), an instance's weight the chance
that one of the trusted patterns it occurs with is right.  Patterns that become
trusted in one round count for the candidates of the next.  Candidates of enough
weight, and candidates whose value is a seed elsewhere, become spans of their
kind; base spans stay as they are and are never overlapped.

Copies of a document add no distinct instance and so no confidence.  All joins
are by pattern or instance; of a very frequent pattern only one row per distinct
instance is kept, and it is counted with partial aggregation.

Results for odd input: a null text counts as empty and has no spans; a null or
repeated doc_id is a row of its own; equal texts have equal spans; texts are read
whole, at any length; an empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_written, table, written

#: kinds in the order in which spans are listed
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: distinct seeds a trusted pattern has at least, its least confidence, rounds of scoring
SUPPORT, CONFIDENCE, ROUNDS = 8, 0.85, 4
#: characters around a span that its context is taken from
AROUND = 64

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED_DIGITS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# loose forms of candidates
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}+[0-9])++")
_GROUP = re.compile(r"[^ ]+")
_AT_WORD = re.compile(r" ?[\[(]at[\])] ?| at |@")
_DOTTED = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| dot | ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+")
_DOT_WORD = re.compile(r" dot | ?[\[(]dot[\])] ?")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and (start := _local_start(text, at, done)) < at:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    for run in _DOTTED_DIGITS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind, then start."""
    found = [(EMAIL, *s) for s in emails(text)] if "@" in text else []
    found += [(IP, *s) for s in ips(text)]
    found += [(CARD, *s) for s in cards(text)]
    return found + ([(PHONE, *s) for s in phones(text)] if "+" in text else [])


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind it could be, start, end) of identifier-like strings that overlap no
    base span and not one another, by start."""
    loose = []
    for m in _AT_WORD.finditer(text):
        start, right = _local_start(text, m.start(), 0), _DOTTED.match(text, m.end())
        if right and start < m.start() and (m.group() == "@" or len(_DOT_WORD.sub(".", right.group()).split(".")) > 1):
            loose.append((EMAIL, start, right.end()))
    for m in _NUMBER.finditer(text):
        pieces = [m.span()]
        if len(_NOT_DIGIT.sub("", m.group())) > 19:  # several numbers in a row
            pieces = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m.group())]
        for start, end in pieces:
            s = text[start:end]
            n = len(_NOT_DIGIT.sub("", s))
            if 7 <= n <= 19 and not (s.count(".") == 3 and _DOTTED_DIGITS.fullmatch(s)):
                loose.append((PHONE if n < 13 or (n <= 15 and s[0] in "+(") else CARD, start, end))
    taken = sorted((s, e) for _, s, e in base)
    out, k, done = [], 0, 0
    for kind, start, end in sorted(loose, key=lambda x: (x[1], x[0])):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= done and not any(s < end and e > start for s, e in taken[k:k + 8]):
            out.append((kind, start, end))
            done = end
    return out


def value_of(kind: int, s: str) -> str:
    """One spelling for all spellings of an identifier."""
    if kind in (CARD, PHONE):
        return _NOT_DIGIT.sub("", s)
    return _DOT_WORD.sub(".", _AT_WORD.sub("@", s, count=1)).lower() if kind == EMAIL else s


def shape_of(kind: int, s: str) -> str:
    if kind == EMAIL:
        return re.sub(r"[A-Za-z0-9_%+-]+", "a", s)[:40]
    digits = _NOT_DIGIT.sub("", s)
    return re.sub("[0-9]", "9", s) + (":luhn" if 13 <= len(digits) <= 19 and luhn(digits) else "")


def patterns_of(text: str, kind: int, start: int, end: int) -> list[str]:
    """The lexical patterns that a span occurs in."""
    low = max(0, start - AROUND)
    left, right = text[low:start].lower().split(), text[end:end + AROUND].lower().split()
    if low and left and not text[low - 1].isspace() and not text[low].isspace() and len(left) > 1:
        left = left[1:]  # began within a word
    w2, w1 = (["^", "^"] + left)[-2:]
    r1, r2 = (right + ["$", "$"])[:2]
    return [f"1 {w1}", f"2 {w2} {w1}", f"m {w1} {r1}", f"r {r1} {r2}", f"s {shape_of(kind, text[start:end])}"]


_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_OCCURRENCE = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("seen", pa.list_(_OCCURRENCE))])


def _found(batches):
    for b in batches:
        base, seen = [], []
        for cell in b.column(1):
            text = cell.as_py() or ""
            own = base_spans(text)
            both = [(True, x) for x in own] + [(False, x) for x in candidates(text, own)]
            base.append([{"k": k, "s": s, "e": e} for k, s, e in own])
            seen.append([{"k": k, "s": s, "e": e, "value": value_of(k, text[s:e]), "seed": seed, "patterns": patterns_of(text, k, s, e)} for seed, (k, s, e) in both])
        yield table(_FOUND, doc_id=b.column(0), base=base, seen=seen)


# ------------------------------------------------------------ the graph

def _chance(conf: Column) -> Column:
    """Chance that at least one of several independent signs is right."""
    return 1 - F.exp(F.sum(F.log(1 - conf)))


def instances_of(seen: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """k, value, w of the instances that ``seen`` (k, value, seed, patterns) makes
    certain enough and that are not seeds themselves."""
    known = seen.filter("seed").select("k", "value").distinct().withColumn("known", F.lit(True))
    edges = seen.select("k", "value", F.explode("patterns").alias("p")).distinct().join(known, ["k", "value"], "left")
    edges = written(edges.select("p", "k", "value", F.coalesce("known", F.lit(False)).alias("known")), "pii-edges")
    open_ = written(edges.filter("not known").select("p", "k", "value"), "pii-open")
    # only patterns with a candidate matter; n counts all distinct instances, seeds those of a kind
    near = edges.join(open_.select("p").distinct(), "p", "left_semi").groupBy("p", "k").agg(F.count("*").alias("n"), F.count_if("known").alias("seeds"))
    total = near.groupBy("p").agg(F.sum("n").alias("n"))
    stats = written(near.filter(F.col("seeds") >= support).drop("n").join(total, "p").select("p", "k", "seeds", "n"), "pii-patterns")
    drop_written(edges)
    w = None
    for _ in range(rounds):
        s = stats.withColumn("extra", F.lit(0.0))
        if w is not None:
            extra = open_.join(w, ["k", "value"]).groupBy("p", "k").agg(F.sum("w").alias("extra"))
            s = stats.join(extra, ["p", "k"], "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
        conf = ((F.col("seeds") + F.col("extra")) / (F.col("n") + 2)).alias("conf")
        trusted = s.select("p", "k", conf).filter(F.col("conf") >= confidence)
        new = written(open_.join(trusted, ["p", "k"]).groupBy("k", "value").agg(_chance(F.col("conf")).alias("w")), "pii-weights")
        if w is not None:
            drop_written(w)
        w = new
    drop_written(open_), drop_written(stats)
    return w


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def personal_data(documents: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of (k, s, e): number
    of the kind, start, end in code points), base_list and spans (as text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    span = "array<struct<k:int,s:int,e:int>>"
    found = docs.mapInArrow(_found, f"doc_id long, base {span}, seen array<struct<k:int,s:int,e:int,value:string,seed:boolean,patterns:array<string>>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    seen = found.select("row", F.inline("seen"))
    sure = instances_of(seen, support, confidence, rounds).select("k", "value")
    sure = sure.unionByName(seen.filter("seed").select("k", "value")).distinct()
    more = seen.filter("not seed").join(sure, ["k", "value"], "left_semi")
    more = more.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e"))).alias("added"))  # one document's
    out = found.select("row", "doc_id", "base").join(more, "row", "left")
    added = F.coalesce("added", F.array().cast(span))
    return out.select("doc_id", "base", added.alias("added"), _listed(F.col("base")).alias("base_list"),
                      _listed(F.array_sort(F.concat("base", added))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, all spans, number of added ones."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2("base_list", 256).alias("base_sha256"), "spans", F.size("added").cast("long").alias("n_added"))
