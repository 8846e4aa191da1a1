"""Exact duplicates by owners in Patricia tries, over partitions of length and content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm.batches import bound_batches, text_parts
from orbitframe.session import read_table, written_table

#: Bytes of text that a task's trie holds before it spills a subtree, and rounds before giving up.
TRIE_BYTES, MAX_ROUNDS = 48 << 20, 64

#: Rows of a round. Members: key, rep (and id in the first round). Terminals: rep, owner, owner_key, n and the text (spilled) or its hash.
ROUND = "key long, rep long, id long, owner long, owner_key long, n long, text binary, sha256 string"


class Node:
    """A node of a trie: the bytes of its edge, children by first byte, and what its terminal stores (None: no terminal)."""

    __slots__ = ("children", "edge", "stub", "terminal")

    def __init__(self, edge: bytes, terminal: list | None = None):
        self.edge, self.terminal, self.children, self.stub = edge, terminal, {}, False


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes a has in common with b from ``at`` on: slices are halved, not bytes walked."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie of whole byte strings; a terminal holds [order, rows, first key] of its string.

    ``order`` is the least of the tuples given for the string. Beyond ``limit`` bytes the heaviest subtrees are
    spilled until half of that is left, but never the last terminal. With ``stubs`` a stub stays where a subtree was,
    and strings that reach it are refused, so a string is never partly here and partly spilled.
    """

    def __init__(self, limit: int, stubs: bool):
        self.root, self.limit, self.stubs, self.bytes, self.terminals = Node(b""), limit, stubs, 0, 0

    def insert(self, text: bytes, order: tuple, n: int, key: int) -> int | None:
        """The first key of the string's terminal, or None if its subtree is spilled."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += len(text) - at
                node, at = child, len(text)
                break
            edge = child.edge
            if not text.startswith(edge, at):
                k = _common(edge, text, at)
                upper = node.children[text[at]] = Node(edge[:k])
                child.edge = edge[k:]
                upper.children[child.edge[0]] = child
                child = upper
            node, at = child, at + len(child.edge)
            if node.stub:
                return None
        if node.terminal is None:
            node.terminal = [order, n, key]
            self.terminals += 1
        else:
            t = node.terminal
            t[0], t[1] = min(t[0], order), t[1] + n
        return node.terminal[2]

    def strings(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """(string, terminal) of a subtree."""
        todo = [(node or self.root, before)]
        while todo:
            node, before = todo.pop()
            text = before + node.edge
            if node.terminal is not None:
                yield text, node.terminal
            todo.extend((c, text) for c in node.children.values())

    def overflow(self) -> Iterator[tuple[bytes, list]]:
        """The terminals of the subtrees that have to go, if the trie is over its limit."""
        while self.bytes > self.limit and self.terminals > 1:
            heavy = self._weights()
            node, path, parent = self.root, b"", None
            # Down the heaviest edges, as long as one subtree alone is more than half of the limit and can be parted.
            while node.children:
                child = max(node.children.values(), key=lambda c: heavy[id(c)][0])
                parent, path, node = node, path + node.edge, child
                weight, count = heavy[id(child)]
                if weight <= self.limit // 2 and count < self.terminals:
                    break
                if not any(heavy[id(c)][1] for c in child.children.values()):
                    break
            weight, count = heavy[id(node)]
            if count == self.terminals:  # a path to the only strings: only its lowest string goes
                weight, count = len(node.edge), 1
            yield from self.strings(node, path)
            self.bytes -= weight
            self.terminals -= count
            first = node.edge[0]
            if self.stubs:
                stub = parent.children[first] = Node(node.edge)
                stub.stub = True
            else:
                del parent.children[first]

    def _weights(self) -> dict[int, tuple[int, int]]:
        """(bytes, terminals) of each node's subtree; a stub weighs nothing."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children.values())
        out: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            parts = [out[id(c)] for c in node.children.values()]
            out[id(node)] = (0 if node.stub else len(node.edge) + sum(p[0] for p in parts), (node.terminal is not None) + sum(p[1] for p in parts))
        return out


def _round(rows: DataFrame, last: bool, largest: bool, limit: int) -> DataFrame:
    """ROUND rows of (key, text, id, owner, owner_key, n): a trie in each task.

    Before the exchange (``last`` False) every terminal is given out with its text, subtrees early where the trie is full; after it,
    terminals are final, and only what is spilled is given out with its text.
    """

    def order_of(owner: int | None, key: int) -> tuple:
        return (owner is None, 0 if owner is None else -owner if largest else owner, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, held = Trie(limit, last), [], 0

        def terminal(text: bytes, t: list, final: bool) -> tuple:
            (lost, owner, owner_key), n, rep = t
            owner = None if lost else -owner if largest else owner
            return (None, rep, None, owner, owner_key, n, None if final else text, hashlib.sha256(text).hexdigest() if final else None)

        def packed() -> pa.RecordBatch:
            nonlocal out, held
            kinds = [pa.int64()] * 6 + [pa.binary(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["key", "rep", "id", "owner", "owner_key", "n", "text", "sha256"])
            out, held = [], 0
            return batch

        for b in batches:
            at = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names) if c != "text"}
            for first, texts in text_parts(b, 1):
                for i, text in enumerate(texts, first):
                    text = (text or b"").lower()  # of bytes lower() changes A-Z alone
                    order = order_of(at["owner"][i], at["owner_key"][i])
                    rep = trie.insert(text, order, at["n"][i], at["key"][i])
                    if rep is None:
                        rep = at["key"][i]
                        out.append(terminal(text, [order, at["n"][i], rep], False))
                        held += len(text)
                    out.append((at["key"][i], rep, at["id"][i], None, None, None, None, None))
                    for gone, t in trie.overflow():
                        out.append(terminal(gone, t, False))
                        held += len(gone)
                        if held > 1 << 20:
                            yield packed()
                    if len(out) >= 4096 or held > 1 << 20:
                        yield packed()
        for text, t in trie.strings():
            out.append(terminal(text, t, last))
            held += len(text) if not last else 0
            if len(out) >= 4096 or held > 1 << 20:
                yield packed()
        if out:
            yield packed()

    return rows.select("key", "text", "id", "owner", "owner_key", "n").mapInArrow(run, ROUND)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256): a row for each row of docs; texts are equal if they are after lower-casing A-Z.

    The row with the smallest id (``keep`` "largest": the largest) of a group stays: keep_id is its id, kept marks it. Null ids
    come last, and of rows of one id the first by a written row key stays, so exactly one row of a group is kept. Null texts are
    empty ones, which form a group. Repeated rows are rows of their own, an empty table gives no rows, other columns, whatever
    their names, aren't read. sha256 is that of the lower-cased text's UTF-8 bytes.

    Each task inserts its texts into a trie, so of equal texts one leaves it, with the number of rows and the owner. These are
    dealt by length and content hash, and whole byte strings decide in the tries there; hashes only deal. A trie over ``limit``
    bytes spills subtrees, before the exchange as partial owners, after it to the next round, written in the shared folder.
    A task holds ``limit`` bytes of text or one longer text, and the edges' overhead.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    bound_batches(docs.sparkSession)
    largest = keep == "largest"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), F.monotonically_increasing_id().alias("key"))
    first = written_table(_round(rows.withColumns({"owner": F.col("id"), "owner_key": F.col("key"), "n": F.lit(1).cast("long")}), False, largest, limit))
    spilled, links, classes, parts = first, None, None, 0
    for _ in range(MAX_ROUNDS):
        src = spilled.where("n is not null and text is not null").select(F.col("rep").alias("key"), "text", F.lit(None).cast("long").alias("id"), "owner", "owner_key", "n")
        deal = (F.length("text"), F.xxhash64("text"))
        src = src.repartition(*deal) if not parts else src.repartition(parts, *deal)
        done = written_table(_round(src, True, largest, limit))
        found = done.where("sha256 is not null").select("rep", "owner", "owner_key", "n", "sha256")
        classes = found if classes is None else classes.unionByName(found)
        step = done.where("n is null").select(F.col("key").alias("from"), F.col("rep").alias("to"))
        if links is None:
            links = step
        else:
            links = links.join(step.withColumnsRenamed({"from": "f2", "to": "t2"}), F.col("to") == F.col("f2"), "left").select("from", F.coalesce("t2", "to").alias("to"))
        if done.where("n is not null and text is not null").isEmpty():
            break
        spilled, parts = done, 4 * (parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts = min(parts, 1 << 14)
    else:
        raise RuntimeError(f"tries still spill after {MAX_ROUNDS} rounds")
    of = links.join(classes, F.col("to") == F.col("rep")).select("from", "owner", "owner_key", "n", "sha256")
    members = first.where("n is null").select("key", "id", "rep")
    out = members.join(of, F.col("rep") == F.col("from"))
    return out.select("id", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"), (F.col("key") == F.col("owner_key")).alias("kept"), "sha256")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP11_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
