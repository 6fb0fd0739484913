"""Duplicates hidden by formatting: Merkle trees of texts and nested records.

A text is a tree. Plain text is one leaf, its words and numbers in their order; a list of named
fields, or a JSON object, is an unordered node of fields. Leaves are normalised (lower case,
letters and digits only) and hashed; every inner node is hashed from the digests of its children,
which an unordered node sorts. Records meet by root digests alone, so texts that occur once are
never shuffled. The canonical structures of those that do meet are then compared in full; a
digest that different structures share is lengthened, and the comparison repeated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import bounded_broadcast, materialised

_SEPARATORS = r"[;|\r\n\x{2028}\x{2029}\x0b\x0c\x85]+"
_FIELD = r"(?s)^[^:：]*[\p{L}\p{N}][^:：]*[:：].*$"
_NAME_END = "[:：]"


def leaf(c: Column) -> Column:
    """A leaf's normal form: its runs of letters and digits in lower case, one space between.
    """
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


_TOKEN = re.compile(
    r"""[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|('(?:[^'\\\x00-\x1f]|\\.)*')|([^ \t\r\n{}\[\],:"']+))"""
)
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|[+-]?INF|[+-]?Infinity", re.ASCII)
_NOTHING = object()


def _string(token: str) -> str:
    """What a quoted JSON string stands for; a ValueError if it is none."""
    if token[0] == "'":
        token = '"' + re.sub(r"\\(.)|\"", lambda m: "'" if m[1] == "'" else m[0] if m[1] else '\\"', token[1:-1], flags=re.DOTALL) + '"'
    return json.loads(token).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _flat(rope: object) -> str:
    """The text of a rope: a string, or a tuple of ropes."""
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x))
    return "".join(out)


def _inner(kind: str, children: list[tuple[str, object]]) -> tuple[str, object]:
    """Digest and structure of an inner node, from those of its children."""
    rope: list[object] = [f"\x02{kind}\x1f"]
    for i, (_, child) in enumerate(children):
        rope += ["\x1f", child] if i else [child]
    return _hash(kind + "\x1f" + "".join(d for d, _ in children)), (*rope, "\x03")


def _field(name: str, value: tuple[str, object]) -> tuple[str, object]:
    return _hash(_hash(name) + value[0]), (name, "\x1e", value[1])


def canonical_json(text: str, normal: Callable[[str], str], kinds: str = "{") -> str | None:
    """The structure of ``merkle_json`` alone."""
    found = merkle_json(text, normal, kinds)
    return None if found is None else _flat(found[1])


def merkle_json(text: str, normal: Callable[[str], str], kinds: str = "{") -> tuple[str, object] | None:
    """Root digest and canonical structure (a rope) of a text that is wholly one JSON object (or one
    of ``kinds``), nested to any depth, else None. ``normal`` gives the normal form of each leaf, in
    the order of the text.

    A string that is itself such a text counts as what it holds. An object without members is an
    empty leaf. Strings may have single quotes.
    """
    leaf_node = lambda x: (_hash(x), x)
    stack: list[tuple[str, list[tuple[str, object]], list[str]]] = []  # kind, children, name that waits for its value
    at, value, end = 0, _NOTHING, len(text.rstrip(" \t\r\n"))
    state = "value"  # what may come: value, first (value or end of a list), name, first name, colon, next, done
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None or state == "done":
            return None
        at = m.end()
        mark, double, single, bare = m.groups()
        value = _NOTHING
        if mark and mark in "{[" and state in ("value", "first") and (stack or mark in kinds):
            stack.append((mark, [], []))
            state = "first name" if mark == "{" else "first"
            continue
        if mark == ":" and state == "colon":
            state = "value"
            continue
        if mark == "," and state == "next":
            state = "name" if stack[-1][0] == "{" else "value"
            continue
        if mark and mark in "}]":
            if not stack or (stack[-1][0] == "{") != (mark == "}") or state not in ("next", "first" if mark == "]" else "first name"):
                return None
            kind, children, _ = stack.pop()
            if kind == "[":
                value = _inner("list", children)
            elif children:
                value = _inner("fields", sorted((c for c in children if c[1] != ("", "\x1e", "")), key=lambda c: c[0]))
            else:
                value = leaf_node("")
        elif mark or not stack:
            return None
        else:
            try:
                leaf_text = bare if bare is not None else _string(double or single)
            except ValueError:
                return None
            if state in ("name", "first name"):
                if bare is not None:
                    return None
                stack[-1][2].append(normal(leaf_text))
                state = "colon"
                continue
            if state not in ("value", "first") or (bare is not None and not _SCALAR.fullmatch(bare)):
                return None
            if bare == "null":
                value = leaf_node("" if stack[-1][0] == "{" else "\x00")
            else:
                inner = None
                if bare is None and leaf_text.lstrip()[:1] in ("{", "[") and merkle_json(leaf_text, lambda _: "", "{[") is not None:
                    inner = merkle_json(leaf_text, normal, "{[")
                value = leaf_node(normal(leaf_text)) if inner is None else inner
        if stack:
            kind, children, names = stack[-1]
            children.append(_field(names.pop(), value) if kind == "{" else value)
            state = "next"
        else:
            state = "done"
    return value if state == "done" and value[1] else None


def _json_leaves(texts: pa.Array) -> pa.Array:
    """Names and values of each JSON object in their order; null for a text that is none."""
    out = []
    for t in texts.to_pylist():
        leaves: list[str] = []
        found = t is not None and merkle_json(t, lambda x: leaves.append(x) or "", "{") is not None
        out.append(leaves if found else None)
    return pa.array(out, pa.list_(pa.string()))


_TREE = pa.struct([("digest", pa.string()), ("form", pa.string())])


def _json_trees(texts: pa.Array, leaves: pa.Array) -> pa.Array:
    """Root digest and structure of each JSON object whose leaves have their normal form."""
    out = []
    for t, normal in zip(texts.to_pylist(), leaves.to_pylist()):
        rest = iter(normal or ())
        found = None if t is None or normal is None else merkle_json(t, lambda _: next(rest), "{")
        out.append(None if found is None else {"digest": found[0], "form": _flat(found[1])})
    return pa.array(out, _TREE)


def with_structure(df: DataFrame, text: str) -> DataFrame:
    """Add ``__sw_words`` (the text as one leaf) and ``__sw_tree`` (root digest and structure of a
    field list: ``digest``, ``form``).

    ``__sw_tree`` is null unless the text is wholly a list of at least two named fields or a
    JSON object, at most between marks that are no letters or digits. Leaves of JSON, few against
    all texts, are normalised by the same expression as those of lists.
    """
    raw = F.col(f"`{text}`")
    segments = F.filter(F.split(raw, _SEPARATORS), lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))
    maybe = raw.contains(":") | raw.contains("：")
    outside = r"[^\p{L}\p{N}]*"
    looks_json = raw.rlike(rf"(?s)^{outside}\{{.*\}}{outside}$") & raw.contains('"')
    df = df.withColumn("__sw_words", leaf(raw))
    df = df.withColumn("__sw_segments", F.when(maybe & ~looks_json & raw.rlike(_SEPARATORS), segments))
    df = df.withColumn("__sw_json", F.when(looks_json, F.regexp_extract(raw, r"(?s)\{.*\}", 0)))
    seg = F.col("__sw_segments")
    name = lambda s: leaf(F.substring_index(F.regexp_replace(s, _NAME_END, ":"), ":", 1))
    value = lambda s: leaf(F.regexp_replace(s, r"(?s)^[^:：]*[:：]", ""))
    is_list = (F.size(seg) >= 2) & F.forall(seg, lambda s: F.regexp_like(s, F.lit(_FIELD)))
    parts = F.transform(F.when(is_list, seg), lambda s: F.struct(name(s).alias("n"), value(s).alias("v")))
    df = df.withColumn("__sw_parts", parts)
    child = lambda x: F.struct(F.md5(F.concat(F.md5(x["n"]), F.md5(x["v"]))).alias("d"), F.concat(x["n"], F.lit("\x1e"), x["v"]).alias("f"))
    df = df.withColumn("__sw_children", F.array_sort(F.transform("__sw_parts", child)))
    children = F.col("__sw_children")
    listed = F.when(
        children.isNotNull(),
        F.struct(
            F.md5(F.concat(F.lit("fields\x1f"), F.array_join(children["d"], ""))).alias("digest"),
            F.concat(F.lit("\x02fields\x1f"), F.array_join(children["f"], "\x1f"), F.lit("\x03")).alias("form"),
        ),
    )
    df = df.withColumn("__sw_json_leaves", F.transform(F.arrow_udf(_json_leaves, "array<string>")("__sw_json"), leaf))
    as_json = F.arrow_udf(_json_trees, "struct<digest:string,form:string>")("__sw_json", "__sw_json_leaves")
    drop = ("__sw_segments", "__sw_json", "__sw_json_leaves", "__sw_parts", "__sw_children")
    return df.withColumn("__sw_tree", F.coalesce(as_json, listed)).drop(*drop)


def digest(c: Column) -> Column:
    """128-bit digest of a leaf."""
    return F.unhex(F.md5(c))


def _confirmed(base: DataFrame, key: str, form: str) -> DataFrame | None:
    """``base`` with longer digests ``key`` where different structures ``form`` share one; None if
    none do. Only rows whose digest repeats are compared, and of a digest only the least and
    greatest structure of each task is shuffled."""
    keyed = base.where(F.col(key).isNotNull())
    repeated = materialised(keyed.groupBy(key).count().where("count > 1").select(key))
    rows = keyed.select(key, form).join(bounded_broadcast(repeated, 1_000_000), key, "left_semi")
    shared = rows.groupBy(key).agg(F.min(form).alias("a"), F.max(form).alias("b")).where("a <> b").select(key)
    shared = materialised(shared)
    if shared.isEmpty():
        return None
    mark = shared.withColumn("__sw_shared", F.lit(True))
    longer = F.when(F.col("__sw_shared"), F.concat(key, F.unhex(F.sha2(F.col(form), 512)))).otherwise(F.col(key))
    return materialised(base.join(bounded_broadcast(mark), key, "left").withColumn(key, longer).drop("__sw_shared"))


def _wordings(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``id``, ``wd``), their wordings (``wd``, ``first_id``, ``copies``, ``fd``) and the field
    lists among these (``fd``, ``first_id``, ``copies``).

    Texts are parsed once, into a table in the checkpoint folder. Digests are grouped with counts
    combined before the shuffle, so a group with a third of all rows is no burden. Wordings of
    field lists, few against all, then meet by their root digests.
    """
    tree = F.col("__sw_tree")
    base = with_structure(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")), "t").where(F.col("__sw_words") != "")
    base = base.select("id", digest(F.col("__sw_words")).alias("wd"), F.unhex(tree["digest"]).alias("fd"), F.col("__sw_words").alias("words"), tree["form"].alias("form"))
    base = materialised(base)
    for key, form in (("wd", "words"), ("fd", "form")):
        while (longer := _confirmed(base, key, form)) is not None:
            base = longer
    wordings = materialised(base.groupBy("wd").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("fd").alias("fd")))
    lists = wordings.where("fd IS NOT NULL").groupBy("fd").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    return base.select("id", "wd"), wordings, lists


def collapse_duplicates(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``first_id``, ``copies``: one row for each group of records with the same text.

    A field list and a plain text with the same wording are the same; of several readings of one
    wording as fields the one of least digest stands for all.

    Cases: null texts and texts without letter or digit are no case and have no row; a null id
    is counted but never first unless all ids of the group are null; an empty table gives an
    empty table; other columns don't matter.
    """
    _, wordings, lists = _wordings(df, id_col, text_col)
    return wordings.where("fd IS NULL").select("first_id", "copies").unionByName(lists.select("first_id", "copies"))


def duplicate_members(df: DataFrame, *, id_col: str, text_col: str, heavy_share: int = 1000) -> DataFrame:
    """``first_id``, ``id``: each record that repeats an earlier one, with the group's first.

    Groups that hold more than one in ``heavy_share`` of all rows are at most ``heavy_share`` in
    number and are joined by broadcast, all others by a shuffle; what is shuffled is ids and
    digests. The cases are those of ``collapse_duplicates``.
    """
    rows, wordings, lists = _wordings(df, id_col, text_col)
    root = lists.where("copies > 1").select("fd", F.col("first_id").alias("root"), F.col("copies").alias("all"))
    plain = wordings.where("fd IS NULL AND copies > 1").select("wd", "first_id", "copies")
    listed = wordings.where("fd IS NOT NULL").join(root, "fd").select("wd", F.col("root").alias("first_id"), F.col("all").alias("copies"))
    groups = materialised(plain.unionByName(listed))
    limit = max(1, rows.count() // heavy_share)
    repeats = F.col("id") != F.col("first_id")
    heavy = groups.where(F.col("copies") > limit).drop("copies")
    light = rows.join(groups.where(F.col("copies") <= limit).drop("copies"), "wd").where(repeats).select("first_id", "id")
    if heavy.isEmpty():
        return light
    return light.unionByName(rows.join(F.broadcast(heavy), "wd").where(repeats).select("first_id", "id"))
