"""JSON-LD as it comes, to a table of nodes: contexts, known prefixes, graphs, containers, fragments and references.

One document is a few kilobytes and is taken apart by a small function in Arrow batches: every object becomes a node once,
with its properties, and what it holds becomes texts and references, however often and in whatever circle nodes name each
other. Everything after that is columns; a reference is followed by a join on document and node, chains of them within a
document's row. Contexts are never fetched: a document's own terms count, and the prefixes of the vocabularies below.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.lookup import small
from tarn.storage import stored

#: Prefixes that documents use, declared or not.
PREFIXES = {
    "schema": "https://schema.org/",
    "hyf": "https://www.opengis.net/def/schema/hy_features/hyf/",
    "gsp": "http://www.opengis.net/ont/geosparql#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "dc": "http://purl.org/dc/terms/",
    "dct": "http://purl.org/dc/terms/",
    "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}
_VOCABULARIES = (*sorted(set(PREFIXES.values())), "http://schema.org/", "http://www.opengis.net/def/schema/hy_features/hyf/")
#: Fragments of one node at most.
FRAGMENTS = 64
#: Digits of a whole number beyond which it is kept as the text that it is: Python reads no more at once.
DIGITS = 4_000
#: Starts, nodes that refer to others, and references of a document up to which these are followed within its row.
GATHERED = 1_000
#: The same of all documents that one task gathers, about.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class Term:
    """What a context says of a name. Without an IRI what it names is left out."""

    iri: str | None
    kind: str | None = None
    containers: tuple[str, ...] = ()
    reverse: bool = False
    context: object = None


@dataclass(frozen=True)
class Scope:
    """The terms in force, and what relative names and addresses are added to."""

    terms: dict[str, Term] = field(default_factory=dict)
    vocabulary: str = ""
    base: str = ""


class _TooManyFragments(Exception):
    """A node has more than ``FRAGMENTS``."""


class _Document:
    """The state of taking one document apart: nodes (id to name to entries in order; an entry is a text or a reference) and what was odd."""

    def __init__(self):
        self.codes: list[str] = []
        self.nodes: dict[str, dict[str, dict[tuple, None]]] = {}
        self.fragments: dict[str, int] = {}
        self.top: dict[str, None] = {}
        self.unnamed = 0

    def note(self, code: str) -> None:
        if code not in self.codes:
            self.codes.append(code)

    def scope(self, context, scope: Scope) -> Scope:
        """The scope below a context. A null clears all; addresses stay unread."""
        for entry in context if isinstance(context, list) else [context]:
            if entry is None:
                scope = Scope()
            elif isinstance(entry, dict):
                if "@import" in entry:
                    self.note("remote_context_ignored")
                terms = dict(scope.terms)
                terms.update((name, self.term(said)) for name, said in entry.items() if not name.startswith("@"))
                base, vocabulary = entry.get("@base", scope.base), entry.get("@vocab", scope.vocabulary)
                scope = Scope(terms, scope.vocabulary, self.joined(scope.base, base) if isinstance(base, str) else "")
                scope = replace(scope, vocabulary=self.iri(vocabulary, scope) or "" if isinstance(vocabulary, str) else "")
            elif isinstance(entry, str) and "schema.org" not in entry:
                self.note("remote_context_ignored")
        return scope

    def joined(self, base: str, text: str) -> str:
        """An address behind a base; one that can't be taken apart stays as it is, and is noted."""
        try:
            return urljoin(base, text)
        except ValueError:
            self.note("address_invalid")
            return text

    def term(self, said) -> Term:
        if not isinstance(said, dict):
            return Term(said if isinstance(said, str) else None)
        reverse, containers = said.get("@reverse"), said.get("@container") or []
        containers = containers if isinstance(containers, list) else [containers]
        if not all(isinstance(c, str) for c in containers):
            self.note("container_invalid")
        iri = reverse if isinstance(reverse, str) else said.get("@id", "") if said else None
        return Term(iri if isinstance(iri, str) else None, said.get("@type"), tuple(c for c in containers if isinstance(c, str)), isinstance(reverse, str), said.get("@context"))

    def iri(self, name: str, scope: Scope, via: frozenset = frozenset()) -> str | None:
        """The IRI or keyword that a name stands for, over any number of terms (``via``: those passed); an unknown name as it is, null if it is to be left out."""
        if name.startswith("@"):
            return name
        term = scope.terms.get(name)
        if term is not None and (term.iri is None or term.iri and term.iri != name):
            return None if term.iri is None or name in via else self.iri(term.iri, scope, via | {name})
        prefix, colon, rest = name.partition(":")
        if colon and not rest.startswith("//"):
            known = scope.terms.get(prefix)
            if known is not None and known.iri and prefix != name and prefix not in via:
                return (self.iri(known.iri, scope, via | {prefix}) or "") + rest
            if prefix in PREFIXES:
                self.note("known_prefix_repaired")
                return PREFIXES[prefix] + rest
        return name if colon else scope.vocabulary + name

    def local(self, iri: str) -> str:
        """The name of a property or type without its vocabulary; others stay as they are."""
        return next((iri[len(v) :] for v in _VOCABULARIES if iri.startswith(v)), iri)

    def address(self, text: str, scope: Scope) -> str:
        """A node's id: a short form of an IRI made whole, a relative one put behind the base."""
        prefix, colon, rest = text.partition(":")
        if text.startswith("_:"):
            return text
        if colon:
            return self.iri(text, replace(scope, terms={k: v for k, v in scope.terms.items() if k == prefix})) or text
        return self.joined(scope.base, text) if scope.base else text

    def add(self, node: str, name: str, entry: tuple) -> None:
        self.nodes.setdefault(node, {}).setdefault(name, {})[entry] = None

    def values(self, value, scope: Scope, outer: Scope, term: Term) -> list[tuple]:
        """The entries (text, reference) of a value. ``outer`` is in force in nodes below."""
        if isinstance(value, list):
            if value and all(isinstance(x, dict) and "@language" in x for x in value):
                value = sorted(value, key=lambda x: not str(x["@language"]).startswith("en"))
            return [e for v in value for e in self.values(v, scope, outer, term)]
        if value is None:
            return []
        if isinstance(value, dict):
            own = self.scope(value["@context"], outer) if "@context" in value else outer
            said = {self.iri(k, own): v for k, v in value.items()}
            if "@value" in said:
                return self.values(said["@value"], scope, outer, Term("")) if not isinstance(said["@value"], dict) else [(json.dumps(said["@value"]), None)]
            for many in ("@list", "@set"):
                if many in said:
                    return self.values(said[many], scope, outer, term)
            return [(None, self.node(value, outer))]
        if isinstance(value, str) and term.kind == "@id":
            return [(None, self.address(value, scope))]
        if isinstance(value, str) and term.kind == "@vocab":
            return [(None, self.iri(value, scope) or value)]
        return [(value if isinstance(value, str) else json.dumps(value), None)]

    def node(self, value: dict, scope: Scope, top: bool = False) -> str:
        """Takes an object apart; returns its id. Objects below it are nodes of their own."""
        scope = outer = self.scope(value["@context"], scope) if "@context" in value else scope
        keys = {k: self.iri(k, scope) for k in value if k != "@context"}
        types = [t for k, v in value.items() if keys.get(k) == "@type" for t in (v if isinstance(v, list) else [v]) if isinstance(t, str)]
        for t in sorted(types):
            if t in scope.terms and scope.terms[t].context is not None:
                scope = self.scope(scope.terms[t].context, scope)
                keys = {k: self.iri(k, scope) for k in value if k != "@context"}
        named = next((v for k, v in value.items() if keys.get(k) == "@id" and isinstance(v, str) and v), None)
        own = self.address(named, scope) if named else f"_:#{self.unnamed}"
        self.unnamed += not named
        rest = {k for k in keys.values() if k not in ("@id", "@graph")}
        if top and (rest or named or "@graph" not in keys.values()):
            self.top[own] = None
        if rest:
            self.fragments[own] = self.fragments.get(own, 0) + 1
            if self.fragments[own] > FRAGMENTS:
                raise _TooManyFragments
        self.nodes.setdefault(own, {})
        for t in types:
            self.add(own, "@type", (self.local(self.iri(t, outer) or t), None))
        self.members(own, value, keys, scope, outer, top)
        return own

    def members(self, own: str, value: dict, keys: dict, scope: Scope, outer: Scope, top: bool) -> None:
        for key, v in value.items():
            iri, term = keys.get(key), scope.terms.get(key, Term(""))
            if iri in ("@graph", "@included"):
                for part in v if isinstance(v, list) else [v]:
                    if isinstance(part, dict):
                        self.node(part, outer, top)
            elif iri == "@reverse" and isinstance(v, dict):
                for name, given in v.items():
                    for _, other in self.values(given, scope, outer, Term("", "@id")):
                        if other:
                            self.add(other, self.local(self.iri(name, scope) or name), (None, own))
            elif iri == "@nest":
                for part in v if isinstance(v, list) else [v]:
                    if isinstance(part, dict):
                        self.members(own, part, {k: self.iri(k, scope) for k in part}, scope, outer, top)
            elif iri is not None and not iri.startswith("@"):
                inner = self.scope(term.context, scope) if term.context is not None else scope
                below = self.scope(term.context, outer) if term.context is not None else outer
                entries = [e for part in self.contained(v, term) for e in self.values(part, inner, below, term)]
                for entry in entries:
                    if not term.reverse:
                        self.add(own, self.local(iri), entry)
                    elif entry[1]:
                        self.add(entry[1], self.local(iri), (None, own))

    @staticmethod
    def contained(value, term: Term) -> list:
        """The values that a container holds under languages, ids, types or other keys; any other value as it is."""
        if not isinstance(value, dict) or not set(term.containers) & {"@language", "@id", "@type", "@index", "@graph"} or any(k.startswith("@") and k != "@none" for k in value):
            return [value]
        if "@language" in term.containers:
            return [x for _, x in sorted(value.items(), key=lambda kv: not kv[0].startswith("en"))]
        if not set(term.containers) & {"@id", "@type", "@index"}:
            return [value]
        mark = next((m for m in ("@id", "@type") if m in term.containers), None)
        return [{mark: k, **x} if mark and isinstance(x, dict) and k != "@none" else x for k, given in value.items() for x in (given if isinstance(given, list) else [given])]


def _matched(text: str) -> bool:
    """Whether all brackets of a text, outside of strings, are closed by their like."""
    open_ = []
    for bracket in re.findall(r"[][{}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.DOTALL)):
        if bracket in "[{":
            open_.append(bracket)
        elif not open_ or open_.pop() + bracket not in ("[]", "{}"):
            return False
    return not open_


@contextmanager
def _room(text: str) -> Iterator[None]:
    """Room for calls as deep as a text may be nested, and terms may lead to terms."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(before + 8 * len(text))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def _parsed(text: str, deep: bool):
    """The value that a JSON text holds; JSONDecodeError if it holds none. ``deep``: nested more than the parser in C goes."""
    for read in (int, lambda digits: int(digits) if len(digits) <= DIGITS else digits):
        decoder = json.JSONDecoder(parse_int=read)
        if deep:
            decoder.parse_object, decoder.parse_array, decoder.parse_string = json.decoder.JSONObject, json.decoder.JSONArray, json.decoder.py_scanstring
            decoder.scan_once = json.scanner.py_make_scanner(decoder)
        try:
            return decoder.decode(text)
        except json.JSONDecodeError:
            raise
        except ValueError:  # a number too long for Python
            continue
    raise AssertionError("a number is kept as it is")


def nodes_of(text: str | None) -> tuple[list[dict], list[str]]:
    """A document's nodes, the top ones first and in order, and codes of what was odd; ``document_parse`` if it is no document.

    A node: id (``_:`` before those that the document doesn't name), place (from 0, of top nodes alone), types, and
    properties, each a list of entries [text, reference]. What only refers to a node that isn't described is no node.

    Only a text that is no JSON, or neither object nor array, is no document. Documents may be nested to any depth. Any other
    failure is an error of this library, and is raised.
    """
    try:
        return _nodes_of(text, False)
    except RecursionError:
        if not _matched(text):
            return [], ["document_parse"]
        with _room(text):
            return _nodes_of(text, True)


def _nodes_of(text: str | None, deep: bool) -> tuple[list[dict], list[str]]:
    document = _Document()
    try:
        parsed = None if text is None else _parsed(text, deep)
    except json.JSONDecodeError:
        parsed = None
    if not isinstance(parsed, dict | list):
        return [], ["document_parse"]
    try:
        for node in parsed if isinstance(parsed, list) else [parsed]:
            if isinstance(node, dict):
                document.node(node, Scope(), True)
    except _TooManyFragments:
        return [], ["fragment_budget"]
    for own, said in list(document.nodes.items()):  # a dataset may name its site instead of being named by it
        if any("Dataset" in t for t, _ in said.get("@type", ())):
            for _, site in said.get("about", ()):
                if document.nodes.get(site):
                    document.add(site, "subjectOf", (None, own))
    rest = [own for own, said in document.nodes.items() if said and own not in document.top]
    return [
        {"id": own, "place": place, "types": [t for t, _ in said.get("@type", ())], "properties": {k: [{"v": v, "r": r} for v, r in entries] for k, entries in said.items() if k != "@type"}}
        for own, place, said in ((own, place if place < len(document.top) else None, document.nodes[own]) for place, own in enumerate([*document.top, *rest]))
    ], document.codes


def _plain(text: str | None) -> str | None:
    """A text with a question mark for each half of a pair of surrogates, as Spark reads it from JSON: Arrow takes no such halves."""
    return text and text.encode("utf-8", "replace").decode()


_TEXTS = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("nodes", _TEXTS), T.StructField("parts", _TEXTS), T.StructField("codes", _TEXTS), T.StructField("version", T.StringType()), T.StructField("profile", T.StringType())]))
def _taken_apart(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for text in bodies:
        nodes, codes = nodes_of(text)
        top, said = [n for n in nodes if n["place"] is not None], {}
        for node in top:
            for key, entries in node["properties"].items():
                name = key.replace("#", "/").replace(":", "/").rsplit("/", 1)[-1]
                if name in ("profileVersion", "profile"):
                    said.setdefault(name, entries[0]["v"] if entries[0]["r"] is None else entries[0]["r"])
        rows.append(([_plain(n["id"]) for n in top], [json.dumps(n) for n in nodes], codes, _plain(said.get("profileVersion")), _plain(said.get("profile"))))
    return pd.DataFrame(rows, columns=["nodes", "parts", "codes", "version", "profile"])


def documents(profiles: DataFrame) -> DataFrame:
    """profiles (profile_uri, body) with nodes (ids of the top ones), parts (all nodes, as JSON), codes, version and profile of each document.

    Taking documents apart is the long part of any job here, and a small compressed file may hold very many: they are dealt
    out to all tasks first.
    """
    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    profiles = profiles.repartition(tasks, "profile_uri", "body")
    # Else Spark would filter by what it finds before documents are dealt out, and so take them apart twice.
    once = _taken_apart.asNondeterministic()
    return profiles.withColumn("_d", once("body")).select(*profiles.columns, "_d.nodes", "_d.parts", "_d.codes", "_d.version", "_d.profile")


#: A node of a document: text and reference are looked up in ``properties`` by name.
NODE = "id string, place int, types array<string>, properties map<string, array<struct<v: string, r: string>>>"


def node_table(profiles: DataFrame) -> DataFrame:
    """A row for each node of each document: profile_uri, node, place, types, properties. Stored: it is joined with itself to follow references.

    As many rows and entries as the documents have objects and values: nothing is copied to where it is referred to.
    """
    return node_rows(documents(profiles))


def node_rows(read: DataFrame) -> DataFrame:
    """The same of documents that have been taken apart: profile_uri and parts."""
    parts = read.select("profile_uri", F.explode("parts").alias("n")).select("profile_uri", F.from_json("n", NODE).alias("n"))
    return stored(parts.select("profile_uri", F.col("n.id").alias("node"), "n.place", "n.types", "n.properties"), "nodes")


def statements(nodes: DataFrame) -> DataFrame:
    """A row for each entry of each node: profile_uri, node, property, nth (from 0), value, reference. Types are property ``@type``."""
    typed = F.transform("types", lambda t: F.struct(t.alias("v"), F.lit(None).cast("string").alias("r")))
    every = nodes.select("profile_uri", "node", F.explode(F.map_concat("properties", F.map_from_arrays(F.array(F.lit("@type")), F.array(typed)))).alias("property", "entries"))
    return every.select("profile_uri", "node", "property", F.posexplode("entries").alias("nth", "e")).select("profile_uri", "node", "property", "nth", F.col("e.v").alias("value"), F.col("e.r").alias("reference"))


def followed(rows: DataFrame, reference: str, nodes: DataFrame, out: str, **fields: Column) -> DataFrame:
    """rows (with profile_uri) and the node that ``reference`` names in the same document, as the struct ``out``; null if it isn't described there.

    ``fields``, of a node's columns, are what is wanted of it instead of node, types and properties; nodes with none of them
    take no part in the join. Nodes compress so well that Spark would take a table of millions for a small one by the size
    of its files, and broadcast it: the join is hinted to be one by shuffles.
    """
    wanted = nodes.select(F.col("profile_uri").alias("_p"), F.col("node").alias("_n"), *([c.alias(f"_f_{name}") for name, c in fields.items()] or ["node", "types", "properties"]))
    if fields:
        wanted = wanted.where(F.coalesce(*[F.when(F.col(f"_f_{name}").isNotNull(), F.lit(True)) for name in fields]))
    target = wanted.select("_p", "_n", F.struct(*([F.col(f"_f_{name}").alias(name) for name in fields] or ["node", "types", "properties"])).alias(out))
    return rows.join(target.hint("merge"), (F.col("profile_uri") == F.col("_p")) & (F.col(reference) == F.col("_n")), "left").drop("_p", "_n")


def reached(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """What can be reached from each start (profile_uri, node) over references: profile_uri, start, node, steps (the fewest; 0 for itself).

    Circles end, references of any depth are followed, and references to nodes that aren't described are reached too. A
    document's references meet in one shuffle and are followed within its row, in as many tasks as all references ask for: a
    task's memory doesn't grow with the table. Documents with more than ``GATHERED`` go another way: see ``_reached_by_joins``.
    """
    named = F.array_compact(F.array_distinct(F.flatten(F.transform(F.map_values("properties"), lambda entries: entries["r"]))))
    links = nodes.select("profile_uri", "node", named.alias("named")).where("profile_uri IS NOT NULL AND size(named) > 0")
    begun = starts.select("profile_uri", "node", F.lit(None).cast(_TEXTS).alias("named"), F.lit(1).alias("entries"))
    rows = stored(links.withColumn("entries", F.size("named") + 1).unionByName(begun), "links")
    counted = rows.groupBy(F.col("profile_uri").alias("_hot")).agg(F.sum("entries").alias("_n"))
    hot = stored(counted.where(F.col("_n") > GATHERED).select("_hot"), "hot")
    if hot.isEmpty():
        return _reached_within(rows)
    same = F.col("profile_uri").eqNullSafe(F.col("_hot"))
    rest, large = (rows.join(small(hot), same, how) for how in ("left_anti", "left_semi"))
    return _reached_within(rest).unionByName(_reached_by_joins(large))


def _reached_within(rows: DataFrame) -> DataFrame:
    """The same of documents' links (named: what a node refers to) and starts (named is null), each document in one row.

    What is reached is kept by levels, from the start on. A level is what the last one names that is in none yet; there are as
    many as nodes that refer to others, at most.
    """
    entries = rows.agg(F.sum("entries")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES))
    is_start = F.col("named").isNull()
    sets = F.collect_set(F.when(is_start, F.struct("node"))).alias("starts"), F.collect_list(F.when(~is_start, F.struct("node", "named"))).alias("links")
    gathered = rows.repartition(tasks, "profile_uri").groupBy("profile_uri").agg(*sets).select("profile_uri", F.explode("starts.node").alias("start"), "links")

    def level(levels: Column, _: Column) -> Column:
        newest = F.element_at(levels, -1)
        via = F.filter("links", lambda link: F.array_contains(newest, link["node"]))
        found = F.array_except(F.flatten(F.transform(via, lambda link: link["named"])), F.flatten(levels))
        return F.when(F.size(newest) == 0, levels).otherwise(F.concat(levels, F.array(found)))

    levels = F.aggregate("links", F.array(F.array("start")), level)
    return gathered.select("profile_uri", "start", F.posexplode(levels).alias("steps", "at")).select("profile_uri", "start", F.explode("at").alias("node"), "steps")


def _reached_by_joins(rows: DataFrame) -> DataFrame:
    """The same where documents have very many references: a join for each step from what the last one found anew.

    A node that a start has reached is marked by its row.
    """
    edges = stored(rows.select("profile_uri", F.col("node").alias("via"), F.explode("named").alias("node")).distinct(), "edges")
    all_ = newest = stored(rows.where("named IS NULL").select("profile_uri", F.col("node").alias("start"), "node", F.lit(0).alias("steps")).distinct(), "reached")
    steps = 0
    while not newest.isEmpty():
        steps += 1
        step = newest.select("profile_uri", "start", F.col("node").alias("via"), (F.col("steps") + 1).alias("steps")).join(edges.hint("merge"), ["profile_uri", "via"]).select("profile_uri", "start", "node", "steps").distinct()
        newest = stored(step.join(all_.hint("merge"), ["profile_uri", "start", "node"], "left_anti"), "newest")
        all_ = all_.unionByName(newest) if steps % 8 else stored(all_.unionByName(newest), "reached")
    return all_


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile files under ``path``, one document each: profile_uri (the file's) and body. A byte order mark is taken off."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("profile_uri"), F.regexp_replace("value", "^﻿", "").alias("body"))
