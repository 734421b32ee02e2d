"""Secrets in texts, found through a trigram index of the documents.

From each rule's regular expression a Boolean query of trigrams is derived that every
match must satisfy: all groups, and of each group one alternative with all its
trigrams. Of each string a match must hold, the first and the last trigram are asked for:
a weaker query with fewer postings, whose candidates are verified in any case. The
trigrams that some rule needs are posted, as rows (trigram, text key). The
queries are a small table by trigram; postings are looked up in it, and intersected:
by text and alternative, whose trigrams must all be there, then by group, then by rule.
Rules without mandatory trigrams scan every text. Candidates are verified with the
expressions on whole texts: their keys are broadcast to the texts if they were counted and
weighed small, else texts are shuffled to them. All of it is DataFrame work: no Python
runs on executors.

A text's key is a 64-bit hash of its content, so copies are posted once, and a text that a
third of all rows hold makes a handful of postings. Two texts with one key are candidates
for each other's rules, which verification settles.

Defined results: a null or empty text has no secrets. Spans count code points from 0,
end exclusive. Repeated rows get the same result each.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.sizing import broadcast_if_small
from millrace.session import checkpointed


@dataclass(frozen=True)
class Rule:
    """`pattern` finds a secret if its group `group` has `least` or more characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Two more public formats: private key blocks, and tokens with a fixed prefix.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("prefixed", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}[A-Za-z0-9]*", 0, 40),
)
RULES = BASE + MORE
#: Sets of strings larger than this are given up for a weaker query.
MAX_STRINGS = 64


def trigram_query(pattern):
    """What a match must hold, lower-cased: a set of groups, each a set of alternatives, each
    a set of trigrams. Every group must have an alternative with all its trigrams."""
    tree = re._parser.parse(pattern)
    groups = set()

    def grams(text):
        return frozenset({text[:3], text[-3:]}) if len(text) >= 3 else frozenset()

    def close(strings):
        # Strings that end here are one group, if all of them hold a trigram. A string that
        # holds another one asks for that in any case.
        strings = {s for s in strings if not any(t != s and t in s for t in strings)}
        alternatives = {grams(s) for s in strings}
        if all(alternatives):
            # One that asks for more than another adds nothing.
            groups.add(frozenset(a for a in alternatives if not any(b < a for b in alternatives)))

    def options(name, value):
        """All strings that one node matches, or None if they are too many."""
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN" and all(str(n) == "LITERAL" for n, _ in value):
            return {chr(v).lower() for _, v in value}
        if name == "SUBPATTERN":
            return joined(value[3], None)
        if name == "BRANCH":
            parts = [joined(part, None) for part in value[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if name == "MAX_REPEAT" and value[1] == 1:
            inner = joined(value[2], None)
            return inner | {""} if inner is not None and value[0] == 0 else inner
        return None

    def joined(nodes, at_break):
        """The strings that `nodes` match in turn. Where they are too many, `at_break` gets
        those so far and a new run begins; without it the answer is None."""
        strings = {""}
        for name, value in nodes:
            found = options(str(name), value)
            if found is not None and len(found) * len(strings) <= MAX_STRINGS:
                strings = {a + b for a in strings for b in found}
            elif at_break is None:
                return None
            else:
                at_break(strings)
                strings = {""}
        return strings

    close(joined(list(tree), close))
    return groups


def _lookup(spark, queries):
    """The queries as a table by trigram: `rule`, `clause`, `option`, and how many trigrams
    the option has; and, by rule, how many clauses."""
    rows, clauses = [], []
    for rule, groups in queries.items():
        clauses.append({"rule": rule, "clauses": len(groups)})
        for k, group in enumerate(sorted(groups, key=sorted)):
            for o, option in enumerate(sorted(group, key=sorted)):
                rows += [{"trigram": t, "rule": rule, "clause": k, "option": o, "asked": len(option)} for t in sorted(option)]

    def small(rows, schema):
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))

    return small(rows, "trigram: string, rule: string, clause: int, option: int, asked: int"), small(clauses, "rule: string, clauses: int")


def _candidates(texts, rules):
    """(key, rules) of texts whose postings satisfy the queries of the rules that have one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    needed = sorted({t for q in queries.values() for g in q for a in g for t in a})
    folded = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in needed]))
    postings = texts.select(F.explode(held).alias("trigram"), "key")
    lookup, clauses = _lookup(texts.sparkSession, queries)
    # As many rows as the rules have trigrams. A copy of a text adds no trigram.
    hits = postings.join(F.broadcast(lookup), "trigram").groupBy("key", "rule", "clause", "option", "asked")
    options = hits.agg(F.size(F.collect_set("trigram")).alias("met"))
    met = options.where("met = asked").groupBy("key", "rule").agg(F.size(F.collect_set("clause")).alias("met"))
    found = met.join(F.broadcast(clauses), "rule").where("met = clauses")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules")), set(queries)


def _spans(rule, order, text):
    """Array of (start, order, label) of the rule's matches in `text`.

    Pieces between matches and the matches themselves tell where each match is.
    """
    # Runs of one class are found whole, so a minimum length can go into the pattern.
    simple = re.fullmatch(r"((?:\w+)?\[[^\]]+\])\+", rule.pattern)
    pattern = rule.pattern
    if simple and rule.group == 0:
        fixed = len(re.match(r"\w*", pattern)[0])
        pattern = f"{simple[1]}{{{rule.least - fixed},}}"
    code = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, code, F.lit(0)), F.length)
    part = whole if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, code, F.lit(rule.group)), F.length
    )
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("size"), part.alias("part"))
    empty = F.expr("cast(array() as array<struct<start:int,at:int,label:string>>)")

    def step(state, match):
        start = state["at"] + match["gap"]
        end = start + match["size"]
        label = F.concat_ws(":", F.lit(rule.kind), start.cast("string"), end.cast("string"))
        row = F.struct(start.alias("start"), F.lit(order).alias("at"), label.alias("label"))
        kept = F.when(match["part"] >= rule.least, F.concat(state["rows"], F.array(row))).otherwise(state["rows"])
        return F.struct(end.alias("at"), kept.alias("rows"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("rows"))
    return F.aggregate(steps, start, step, lambda state: state["rows"])


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """`doc_id`, `text` and, per rule, `spans_<kind>`: (start, at, label) of its secrets."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    candidates, indexed = _candidates(texts, rules)
    joined = texts.join(broadcast_if_small(checkpointed(candidates)), "key", "left")
    none = F.expr("cast(array() as array<struct<start:int,at:int,label:string>>)")
    columns = []
    for order, rule in enumerate(rules):
        spans = _spans(rule, order, F.col("text"))
        if rule.kind in indexed:
            wanted = F.array_contains("rules", rule.kind)
        else:
            # No trigram is mandatory: every text that has a match at all.
            wanted = F.col("text").rlike(
                rule.pattern.replace("]+", f"]{{{rule.least},}}") if rule.group == 0 else rule.pattern
            )
        columns.append(F.when(wanted, spans).otherwise(none).alias(f"spans_{rule.kind}"))
    return joined.select("doc_id", "text", *columns)


def _listed(spans):
    return F.array_join(F.transform(F.array_sort(spans), lambda s: s["label"]), ",")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, per document."""
    found = find(docs, rules)
    base = [f"spans_{r.kind}" for r in BASE]
    every = [f"spans_{r.kind}" for r in rules]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(c.replace("spans_", "n_")) for c in base],
        F.sha2(_listed(F.concat(*base)), 256).alias("base_sha256"),
        _listed(F.concat(*every)).alias("spans"),
    )
