"""Language-model scoring with a hierarchical Pitman-Yor model.

Every token is a customer.  It enters the restaurant of its context, the word
before (by its 64-bit hash; a text begins after a start mark), and is served its
word.  A customer that opens a table sends one customer
to the parent, the root restaurant, which all contexts share; a new table there
is drawn from the uniform base over the V known words and one unknown.

    p(w | u) = (c_uw - d1 t_uw + (s1 + d1 T_u) p(w)) / (s1 + c_u)
    p(w)     = (T_w - d0 t_w + (s0 + d0 t) / (V + 1)) / (s0 + T)

c: customers, t: tables; T_u: tables of context u, T_w: tables of all contexts
that serve w, which are the root's customers.  Counts come from training
documents; the seating is sampled by Gibbs: a step takes all customers of a word
out of a restaurant and seats them anew given all others, which draws the number
of tables from its conditional, in proportion to a^t S(c, t), with a the weight
of a new table and S the generalised Stirling numbers of discount d.  (For more
than ``EXACT`` customers the first so many are drawn so, the others follow by the
predictive rule, a sixteenth at a time.)  After ``BURN`` sweeps, ``KEEP`` sweeps
are kept, and a token's probability is the average of theirs.

On Spark: words go to buckets by hash, with all of their contexts, so every count
that concerns one word lives in one bucket.  A sweep is one pass over the buckets;
what couples them is c_u and T_u of every context and a few totals.  A bucket
lists the contexts that documents, held out or not, ask it for.  After every sweep
it writes its own part of their sums; these are grouped by ranges of the context's
hash, added up and joined back to every bucket that lists the context, so there
are as many restaurants as words and none is held in one place.
Batches of documents send each bucket their distinct (word, context) pairs, so a
frequent word is one entry per batch: first with training counts, to build the
model, and in the end with the documents they occur in, to be scored.  A bucket
that is asked for more than ``ASK`` tokens, as that of a very frequent word, is
scored in several groups of batches, each with a copy of its model; a group
returns sums of the documents that asked it.  Documents are scored in ``SLICES``
parts, told apart by a hash of the row, and each part's scores written, so that
the exchange of one part only is on disk beside the model.

Words are told apart by 64-bit hashes.  Results for odd input: a null or empty
text is the end token alone; a null id counts as an empty one for the choice of
training documents and is returned as null; repeated rows are documents each;
without training documents all probabilities are the base's; an empty table gives
an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import gc
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import BUCKET_DOCS, batched, packed, unpacked
from .common import drop_written, pieces, table, written
from .words import distinct, hashes, tokens  # noqa: F401 (the first two: for the tests)

#: discount and strength of the root and of the contexts
D0, S0, D1, S1 = 0.7, 50.0, 0.8, 10.0
BURN, KEEP, EXACT = 2, 2, 32
SEED = 2006
#: tokens that a group of cells asks for, on average at most
ASK = 4_000_000
#: parts of the documents, scored one after the other: the cells of one part are on disk at a time
SLICES = 4
END, START = np.uint64(0xE0D0FD0C), np.uint64(0x57A27)


# ---- seating -------------------------------------------------------------

def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) of discount d."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1:c + 2] = np.logaddexp(s[c, 0:c + 1], s[c, 1:c + 2] + np.log(np.maximum(c - d * t, 1e-300)))
    return s


_STIRLING = {d: log_stirling(d) for d in {D0, D1}}


def seat(c: np.ndarray, a: np.ndarray, d: float, rng) -> np.ndarray:
    """Numbers of tables of c customers of one word each, when a new table has
    weight a."""
    t = np.ones(len(c), np.int64)
    first = np.minimum(c, EXACT)
    log_a = np.log(np.maximum(a, 1e-300))
    stirling = _STIRLING.get(d)
    if stirling is None:
        stirling = log_stirling(d)
    several = np.flatnonzero(first > 1)
    of_several = first[several]
    for n in np.unique(of_several).tolist():
        at = several[of_several == n]
        for k in range(0, len(at), 65536):
            part = at[k:k + 65536]
            w = log_a[part, None] * np.arange(1, n + 1) + stirling[n, 1:n + 1]
            w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
            t[part] = 1 + (w < rng.random(len(part))[:, None] * w[:, -1:]).sum(1)
    at, n = np.flatnonzero(c > EXACT), EXACT
    while len(at):
        m = np.minimum(max(1, n // 16), c[at] - n)
        p = a[at] / (a[at] + np.maximum(n + (m - 1) / 2 - d * t[at], 1 - d))
        t[at] += rng.binomial(m, p)
        n += max(1, n // 16)
        at = at[c[at] > n]
    return t


class Bucket:
    """The words of one bucket: pairs (word, context) with counts and seating."""

    def __init__(self, words_: np.ndarray, word: np.ndarray, context: np.ndarray, c: np.ndarray, contexts: np.ndarray | None = None):
        self.words, self.word, self.context, self.c = words_, word, context, c  # word, context: indexes; pairs sorted by (word, context)
        self.contexts = np.arange(context.max() + 1 if len(context) else 0, dtype=np.uint64) if contexts is None else contexts
        self.count = np.bincount(word, weights=c, minlength=len(words_)).astype(np.int64)
        self.t = np.ones(len(c), np.int64)
        self.t0 = np.ones(len(words_), np.int64)

    def root_customers(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=t, minlength=len(self.words)).astype(np.int64)

    def context_sums(self, of: np.ndarray) -> np.ndarray:
        """Sums per context; one more, 0, for a context that is not listed."""
        return np.bincount(self.context, weights=of, minlength=len(self.contexts) + 1).astype(np.int64)

    def sweep(self, g: "Totals", rng) -> None:
        """Seat all customers anew, each given the others."""
        t_w = self.root_customers(self.t)
        rest = t_w[self.word] - self.t
        tables = np.minimum(self.t0[self.word], rest)  # no more tables than customers that stay
        own = rest - D0 * tables + (S0 + D0 * np.maximum(g.root_tables - (self.t0[self.word] - tables), 0)) / (g.v + 1)
        p = own / (S0 + np.maximum(g.root_customers - self.t, 0))
        a = (S1 + D1 * np.maximum(g.tables[self.context] - self.t, 0)) * p
        self.t = seat(self.c, a, D1, rng)
        a0 = np.full(len(self.words), 1.0) * (S0 + D0 * np.maximum(g.root_tables - self.t0, 0)) / (g.v + 1)
        self.t0 = seat(self.root_customers(self.t), a0, D0, rng)


class Totals:
    """Sums over all buckets: customers and tables of a bucket's contexts,
    root sums, the number of known words and of training tokens."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, root_tables: int, v: int, root_customers: int | None = None, n: int | None = None):
        self.customers, self.tables, self.root_tables, self.v = customers, tables, int(root_tables), int(v)
        self.root_customers = int(tables.sum() if root_customers is None else root_customers)
        self.n = int(customers.sum() if n is None else n)

    def root(self, t_w, t0):
        return (t_w - D0 * t0 + (S0 + D0 * self.root_tables) / (self.v + 1)) / (S0 + self.root_customers)

    def context(self, u, c, t, p_root):
        return (c - D1 * t + (S1 + D1 * self.tables[u]) * p_root) / (S1 + self.customers[u])


# ---- batches to buckets ----------------------------------------------------

_STATE = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("home", pa.int64()), ("data", pa.binary())])
_STATE_SQL = "bucket long, part int, home long, data binary"
#: parts of a bucket's rows: cells (``home``: their batch), the counts with seating, totals, sums
#: of its contexts (a row per range ``home`` of the context's hash), number ``home`` of groups to ask
ASKED, MODEL, SUMS, CONTEXT, GROUPS = 0, 1, 2, 3, 4


def is_training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def _planes(h: np.ndarray) -> np.ndarray:
    """Sorted hashes as eight planes of bytes, of which the first ones compress."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def _hashes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _edges(keys: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each of n ranges of the hash begins and ends among sorted ``keys``."""
    e = np.searchsorted(keys, np.array([(b << 64) // n for b in range(1, n)], np.uint64)).tolist()
    return list(zip([0, *e], [*e, len(keys)]))


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys below ``most``; plain numbers sort faster than places by key."""
    n = len(key)
    if n and most * n < 1 << 63:
        return np.sort(key * n + np.arange(n)) % n
    return np.argsort(key, kind="stable")


def _ranked(x: np.ndarray, most: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every stretch of ``x`` between two ``ends`` its sorted distinct values
    (below ``most``), one list after the other; the place of every entry in the
    list of its stretch; where the lists begin and end."""
    key = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * most + x
    order = _order(key, (len(ends) - 1) * most)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    lists = np.append(0, np.cumsum(new))[ends]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1 - np.repeat(lists[:-1], np.diff(ends))
    return key[new] % most, place, lists


def _cells(buckets: int, score: bool):
    """Cells of every batch: all pairs with their documents (``score``), or
    with their counts in training documents, which may be 0."""
    def cells(record_batches):
        for number, ids, texts in batched(record_batches):
            h, at, counts = tokens(texts)
            h, at = np.append(h, END), np.insert(at, np.cumsum(counts), len(h))  # an end after every text
            counts = counts + 1
            starts = np.concatenate([[0], np.cumsum(counts)])
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), counts)
            vocabulary, word = np.unique(h, return_inverse=True)
            word = word[at]
            begin = int(np.searchsorted(vocabulary, START))
            new = begin == len(vocabulary) or vocabulary[begin] != START
            contexts = np.insert(vocabulary, begin, START) if new else vocabulary
            context = np.concatenate([[0], word[:-1]])  # the word before, by its place among the contexts
            context += new & (context >= begin)
            context[starts[:-1]] = begin
            pair = word * len(contexts) + context
            order = _order(pair, len(vocabulary) * len(contexts))
            pair, doc = pair[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            token = np.append(at, len(pair))
            pair = pair[at]
            first = np.searchsorted(pair // len(contexts), np.arange(len(vocabulary) + 1))  # pairs of each word
            train = np.concatenate([[0], np.cumsum(np.array([is_training(i) for i in ids])[doc])])
            home = number % buckets
            edges = _edges(vocabulary, buckets)
            ends = first[[0, *(hi for _, hi in edges)]]
            own, at_context, own_ends = _ranked(pair % len(contexts), len(contexts), ends)
            own = contexts[own]
            for b, (lo, hi) in enumerate(edges):
                p, q = int(ends[b]), int(ends[b + 1])
                cell = {"batch": np.array([number]), "words": _planes(vocabulary[lo:hi]), "pairs": np.diff(first[lo:hi + 1]).astype(np.uint32), "contexts": _planes(own[own_ends[b]:own_ends[b + 1]]), "context": _small(at_context[p:q])}
                if score:
                    cell |= {"tokens": np.diff(token[p:q + 1]).astype(np.uint32), "doc": doc[token[p]:token[q]]}
                else:
                    cell |= {"tokens": np.diff(train[token[p:q + 1]]).astype(np.uint32), "asked": np.array([token[q] - token[p]])}
                if score and b == home:
                    cell |= {"ids": np.array([0 if i is None else i for i in ids], np.int64), "known": np.array([i is not None for i in ids], np.uint8), "n": counts}
                if hi > lo or score and b == home:
                    yield table(_STATE, bucket=[b], part=[ASKED], home=[number], data=[packed(**cell)])
    return cells


def _state(bucket: int, buckets: int, b: Bucket, kept: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """Rows of the model and of the sums that the next sweep needs.  ``kept``:
    tables of pairs and words of every kept sweep, and of the contexts where
    the next sweep has brought them."""
    arrays = {"words": _planes(b.words), "pairs": np.bincount(b.word, minlength=len(b.words)).astype(np.uint32), "context": _small(b.context), "c": _small(b.c), "t": _small(b.t), "t0": _small(b.t0)}
    for k, sample in enumerate(kept):
        arrays |= {f"{name}.{k}": _small(x) for name, x in zip(("t", "t0", "tables"), sample)}
    c, t = b.context_sums(b.c), b.context_sums(b.t)
    sums = {"sums": np.array([c.sum(), t.sum(), b.t0.sum(), len(b.words)], np.int64)}
    out = [(bucket, MODEL, 0, packed(**arrays)), (bucket, SUMS, 0, packed(**sums))]
    out += [(bucket, CONTEXT, home, packed(contexts=_planes(b.contexts[lo:hi]), customers=_small(c[lo:hi]), tables=_small(t[lo:hi])))
            for home, (lo, hi) in enumerate(_edges(b.contexts, buckets)) if hi > lo]
    return pa.Table.from_batches([table(_STATE, **dict(zip(_STATE.names, zip(*out))))])


def _loaded(rows) -> tuple[Bucket, list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """The bucket, what was kept, and the totals c_u and T_u of its contexts,
    from a group with its model and the answers to its contexts."""
    part, home, data = rows.column("part").to_numpy(), rows.column("home").to_numpy(), rows.column("data")
    a = unpacked(data[int(np.flatnonzero(part == MODEL)[0])].as_py())
    at = np.flatnonzero(part == CONTEXT)
    answers = [unpacked(data[int(k)].as_py()) for k in at[np.argsort(home[at], kind="stable")]]
    contexts = np.concatenate([_hashes(x["contexts"]) for x in answers])
    customers, tables = (np.append(np.concatenate([x[name] for x in answers]), 0).astype(np.int64) for name in ("customers", "tables"))
    b = Bucket(_hashes(a["words"]), np.repeat(np.arange(len(a["pairs"])), a["pairs"]), a["context"].astype(np.int64), a["c"].astype(np.int64), contexts)
    b.t, b.t0 = a["t"].astype(np.int64), a["t0"].astype(np.int64)
    kept = []
    while f"t.{len(kept)}" in a:
        k = len(kept)
        kept.append((a[f"t.{k}"].astype(np.int64), a[f"t0.{k}"].astype(np.int64), a[f"tables.{k}"].astype(np.int64) if f"tables.{k}" in a else tables))
    return b, kept, customers, tables


def _counted(buckets: int, most: int):
    """The cells of a bucket merged into its counts."""
    def count(key, rows):
        ws, ns, us, at, cs, asked, listed = [], [], [], [], [], 0, 0
        for x in rows.column("data"):
            cell = unpacked(x.as_py())
            ws.append(_hashes(cell["words"])), ns.append(cell["pairs"]), us.append(_hashes(cell["contexts"])), at.append(cell["context"].astype(np.int64) + listed), cs.append(cell["tokens"])
            asked, listed = asked + int(cell["asked"][0]), listed + len(us[-1])
        # words and contexts are told apart by cell, where each is listed once, not by pair
        contexts, u = np.unique(np.concatenate(us), return_inverse=True)
        vocabulary, word = np.unique(np.concatenate(ws), return_inverse=True)
        u, word, c = u[np.concatenate(at)], np.repeat(word, np.concatenate(ns)), np.concatenate(cs)
        del ws, ns, us, at, cs
        u, word, c = u[c > 0], word[c > 0], c[c > 0]
        trained = np.zeros(len(vocabulary), bool)
        trained[word] = True
        vocabulary, word = vocabulary[trained], (np.cumsum(trained) - 1)[word]
        pair = word * len(contexts) + u
        del word, u
        order = _order(pair, len(vocabulary) * len(contexts))
        pair, c = pair[order], c[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)]
        c = np.bincount(np.cumsum(new) - 1, weights=c, minlength=new.sum()).astype(np.int64)
        pair = pair[new]
        b = Bucket(vocabulary, pair // len(contexts), pair % len(contexts), c, contexts)
        groups = table(_STATE, bucket=[key[0].as_py()], part=[GROUPS], home=[pieces(asked, most)], data=[b""])
        return pa.concat_tables([_state(key[0].as_py(), buckets, b, []), pa.Table.from_batches([groups])])
    return count


def _dealt(cells: DataFrame, model: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells and models with the group they go to: cells by their batch, a
    model to all groups of its bucket."""
    n = F.coalesce("groups", F.lit(1))
    cells = cells.join(groups, "bucket", "left").withColumn("group", F.pmod(F.xxhash64("home"), n))
    model = model.join(groups, "bucket", "left").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return cells.unionByName(model).select("group", *_STATE.names)


def _added(key, rows):
    """The sums of the contexts in one range of the hash, for every bucket that lists them."""
    blocks = [unpacked(x.as_py()) for x in rows.column("data")]
    contexts, where = np.unique(np.concatenate([_hashes(b["contexts"]) for b in blocks]), return_inverse=True)
    customers, tables = (np.bincount(where, weights=np.concatenate([b[name] for b in blocks]), minlength=len(contexts)).astype(np.int64)[where] for name in ("customers", "tables"))
    out, e = [], 0
    for b in blocks:
        lo, e = e, e + len(b["tables"])
        out.append(packed(contexts=b["contexts"], customers=_small(customers[lo:e]), tables=_small(tables[lo:e])))
    return rows.set_column(rows.column_names.index("data"), "data", pa.array(out, pa.binary())).select(_STATE.names)


def _with_totals(state: DataFrame) -> DataFrame:
    """The models, and for every bucket the totals of its contexts."""
    answers = state.filter(F.col("part") == CONTEXT).groupBy("home").applyInArrow(_added, _STATE_SQL)
    return state.filter(F.col("part") == MODEL).unionByName(answers)


def _totals(state: DataFrame) -> list[int]:
    """Training tokens, tables of all contexts, root tables and known words:
    partial sums per partition, then on the driver a row of four numbers each."""
    def add(record_batches):
        total = np.zeros(4, np.int64)
        for r in record_batches:
            for data in r.column(0):
                total = total + unpacked(data.as_py())["sums"]
        yield pa.RecordBatch.from_arrays([pa.array([packed(sums=total)], pa.binary())], names=["data"])

    sums = state.filter(F.col("part") == SUMS).select("data")
    parts = sums.mapInArrow(add, "data binary").repartition(16).mapInArrow(add, "data binary").collect()
    return sum((unpacked(r.data)["sums"] for r in parts), np.zeros(4, np.int64)).tolist()


def _of(totals: list[int], customers: np.ndarray, tables: np.ndarray) -> Totals:
    n, root_customers, root_tables, v = totals
    return Totals(customers, tables, root_tables, v, root_customers, n)


def _sweep(totals: list[int], number: int, keep: bool, buckets: int, seed: int):
    def sweep(key, rows):
        bucket = key[0].as_py()
        b, kept, customers, tables = _loaded(rows)
        b.sweep(_of(totals, customers, tables), np.random.default_rng([seed, number, bucket]))
        return _state(bucket, buckets, b, kept + ([(b.t, b.t0)] if keep else []))
    return sweep


_SUM = pa.schema([("batch", pa.int64()), ("data", pa.binary())])


def _scored(samples: list[list[int]], n: int, v: int):
    """Sums of the documents of every cell of a group."""
    def score(key, rows):
        data, part = rows.column("data"), rows.column("part").to_numpy()
        if (part == ASKED).any() and (part == MODEL).any():
            b, kept, customers, _ = _loaded(rows)
        elif (part == ASKED).any():  # the home cell of a batch in a bucket without any word
            b, customers = Bucket(*[np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]), np.zeros(1, np.int64)
            kept = [(np.empty(0, np.int64), np.empty(0, np.int64), customers)] * KEEP
        else:
            return _SUM.empty_table()
        known_pairs = b.word * (len(b.contexts) + 1) + b.context
        kept = [(_of(totals, customers, of_contexts), b.root_customers(t), t, t0) for (t, t0, of_contexts), totals in zip(kept, samples)]
        out = []
        for k in np.flatnonzero(part == ASKED):
            cell = unpacked(data[int(k)].as_py())
            cell["words"] = _hashes(cell["words"])
            u = np.searchsorted(b.contexts, _hashes(cell["contexts"]))[cell["context"]]  # all are listed
            if len(b.words):
                at = np.minimum(np.searchsorted(b.words, cell["words"]), len(b.words) - 1)
                known = b.words[at] == cell["words"]
                count = np.where(known, b.count[at], 0)
                wanted = np.repeat(at, cell["pairs"]) * (len(b.contexts) + 1) + u
                where = np.minimum(np.searchsorted(known_pairs, wanted), len(known_pairs) - 1)
                seen = (known_pairs[where] == wanted) & np.repeat(known, cell["pairs"])
            else:
                count, seen = np.zeros(len(cell["words"]), np.int64), np.zeros(len(u), bool)
            p = np.zeros(len(u))
            for g, t_w, t, t0 in kept:
                if len(b.words):
                    root = g.root(np.where(known, t_w[at], 0), np.where(known, t0[at], 0))
                    c, tables = np.where(seen, b.c[where], 0), np.where(seen, t[where], 0)
                else:
                    root, c, tables = g.root(np.zeros(len(count)), 0), 0, 0
                p += g.context(u, c, tables, np.repeat(root, cell["pairs"]))
            log_p = np.log10(p / len(kept))
            base = np.repeat(np.log10((count + 0.5) / (n + 0.5 * (v + 1))), cell["pairs"])
            docs = np.flatnonzero(np.bincount(cell["doc"])).astype(np.uint16)
            add = lambda x: np.bincount(cell["doc"], weights=np.repeat(x, cell["tokens"]))[docs]
            more = {k: cell[k] for k in ("ids", "known", "n") if k in cell}
            out.append((int(cell["batch"][0]), packed(docs=docs, score=add(log_p), base=add(base), hits=add(np.repeat(count > 0, cell["pairs"]).astype(float)).astype(np.int32), **more)))
        return pa.Table.from_batches([table(_SUM, **dict(zip(_SUM.names, zip(*out))))] if out else [], schema=_SUM)
    return score


_DONE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
_DONE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _summed(n_train: int):
    def add(key, rows):
        home, cells = {}, []
        for x in rows.column("data"):
            cell = unpacked(x.as_py())
            home |= {k: cell.pop(k) for k in ("ids", "known", "n") if k in cell}
            cells.append(cell)
        total = {k: np.zeros(len(home["n"])) for k in ("score", "base", "hits")}
        for cell in cells:
            for k, v in total.items():
                v[cell["docs"]] += cell[k]
        ids = [i if k else None for i, k in zip(home["ids"].tolist(), home["known"].tolist())]
        return pa.Table.from_batches([table(_DONE, doc_id=ids, held_out=[not is_training(i) for i in ids], n_tokens=home["n"], n_known=total["hits"].astype(np.int64),
                                            train_tokens=np.full(len(ids), n_train), base_score=total["base"], score=total["score"], perplexity=10 ** np.minimum(-total["score"] / home["n"], 300))])
    return add


def _forget_shuffles(spark) -> None:
    """Spark deletes shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability), perplexity."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = pieces(docs.count(), BUCKET_DOCS)
    model = old = written(d.mapInArrow(_cells(buckets, False), _STATE_SQL).groupBy("bucket").applyInArrow(_counted(buckets, ASK), _STATE_SQL), "counts")
    groups = written(model.filter((F.col("part") == GROUPS) & (F.col("home") > 1)).select("bucket", F.col("home").alias("groups")), "groups")
    samples = []
    g = _totals(model)
    for number in range(BURN + KEEP):
        keep = number >= BURN
        new = written(_with_totals(model).groupBy("bucket").applyInArrow(_sweep(g, number, keep, buckets, seed), _STATE_SQL), "seating")
        drop_written(old)
        model = old = new
        _forget_shuffles(spark)
        g = _totals(model)
        if keep:
            samples.append(g)
    model = written(_with_totals(model), "answered")
    drop_written(old)
    slices, done = min(SLICES, buckets), []
    for k in range(slices):
        _forget_shuffles(spark)
        part = d.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        both = _dealt(part.mapInArrow(_cells(buckets, True), _STATE_SQL), model, groups)
        sums = both.groupBy("bucket", "group").applyInArrow(_scored(samples, g[0], g[3]), "batch long, data binary")
        done.append(written(sums.groupBy("batch").applyInArrow(_summed(g[0]), _DONE_SQL), "scored"))
        del both, sums
    _forget_shuffles(spark)
    return reduce(DataFrame.unionByName, done)
