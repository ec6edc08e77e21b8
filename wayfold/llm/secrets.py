"""Secret scanning through a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression is analysed into a Boolean trigram query in conjunctive form: every
   clause must hold, a clause holds if all trigrams of one of its alternatives occur. A rule without
   mandatory trigrams has no clause, and scans every document.
2. The index: for blocks of documents (by a hash of the id, so that a block is bounded whatever the
   data), the posting list of every trigram that some rule asks for.
3. Posting lists are intersected and united as the queries say, which gives each document's rules.
4. Only those rules' expressions run over the whole text; spans are in code points, end exclusive.

Nulls and edge cases: a null text is an empty text; a document with a null id has no posting and is
scanned by every rule; repeated rows are scanned each; an empty table gives an empty table; columns
besides the id and the text are ignored.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from re._constants import ASSERT, ASSERT_NOT, AT, BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, NOT_LITERAL, POSSESSIVE_REPEAT, RANGE, SUBPATTERN

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, small

#: Documents that an index block holds on average.
BLOCK_DOCUMENTS = 2048
#: Strings that the analysis keeps for one stretch of an expression before it settles them.
MOST_STRINGS = 48
#: Trigrams kept for each alternative of a clause. All of them are mandatory, so fewer only leave more to verify.
GRAMS_KEPT = 2
#: Letters by falling frequency in running text: a trigram of late ones has short posting lists. Fixed value.
COMMON_FIRST = "etaonirshldcumfpgwybvkxjqz"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression (Java and RE2 syntax), and the least length of one of
    its groups. `ignore_case` has ASCII letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False


#: The three base kinds, in the order in which equal starts are listed, then the kinds this method adds.
#: The runs of the second and third base kind have their least length in the expression: a run that
#: is long enough is matched whole, and no part of a shorter one is.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")

Clause = frozenset[frozenset[str]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def clause_of(strings: set[str]) -> Clause | None:
    """One of these strings occurs. None if that says nothing about trigrams."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    rarity = lambda g: (sum(COMMON_FIRST.find(c) % 40 for c in g), g)  # noqa: E731  other characters are rarest
    found = {trigrams(s) for s in strings}
    least = [x for x in found if not any(y < x for y in found)]
    return frozenset(frozenset(sorted(x, key=rarity)[-GRAMS_KEPT:]) for x in least)


def trigram_query(pattern: str) -> set[Clause]:
    """The clauses that every text with a match satisfies, over lower-cased text."""
    clauses: set[Clause] = set()

    def settle(strings: set[str]) -> None:
        if (c := clause_of(strings)) is not None:
            clauses.add(c)

    def strings_of(items) -> set[str] | None:
        """All strings that these items match, lower-cased, or None if they are too many or endless."""
        out = {""}
        for op, arg in items:
            step = single(op, arg)
            if step is None or len(out) * len(step) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in step}
        return out

    def single(op, arg) -> set[str] | None:
        if op is LITERAL:
            return {chr(arg).lower()}
        if op is IN:
            chars: set[str] = set()
            for kind, what in arg:
                if kind is LITERAL:
                    chars.add(chr(what).lower())
                elif kind is RANGE and what[1] - what[0] < MOST_STRINGS:
                    chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is SUBPATTERN:
            return strings_of(arg[-1])
        if op is BRANCH:
            parts = [strings_of(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (MAX_REPEAT, MIN_REPEAT, POSSESSIVE_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
            inner = strings_of(arg[2])
            if inner is None:
                return None
            out, run = ({""} if arg[0] == 0 else set()), {""}
            for k in range(1, arg[1] + 1):
                run = {a + b for a in run for b in inner}
                if len(run) > MOST_STRINGS:
                    return None
                out |= run if k >= arg[0] else set()
            return out
        if op is AT:
            return {""}
        return None

    def walk(items) -> None:
        strings = {""}
        for op, arg in items:
            step = single(op, arg)
            if step is not None and len(strings) * len(step) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in step}
                continue
            settle(strings)
            strings = {""}
            if step is not None:
                strings = step
            elif op is SUBPATTERN:
                walk(arg[-1])
            elif op in (MAX_REPEAT, MIN_REPEAT, POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
            elif op in (ASSERT, ASSERT_NOT, NOT_LITERAL):
                pass
        settle(strings)

    walk(sre.parse(pattern))
    return clauses


def any_of(grams: list[str]) -> str:
    """An expression that finds these trigrams at every place, overlapping ones too: a look-ahead over
    the trigrams by their first, then second, then third character."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in grams:
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    chars = lambda cs: "[" + "".join("\\" + c if not c.isalnum() else c for c in cs) + "]"
    firsts = [chars(a) + "(?:" + "|".join(chars(b) + chars(cs) for b, cs in by.items()) + ")" for a, by in tree.items()]
    return f"(?={chars(tree)})(?=({'|'.join(firsts)}))"


def build_index(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """(block, gram, ids): a posting list of each wanted trigram for each block of documents."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(grams)), F.lit(1)))
    return (
        docs.filter("doc_id IS NOT NULL")
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", F.explode(held).alias("gram"))
        .groupBy("block", "gram")
        .agg(F.collect_set("doc_id").alias("ids"))
    )


def answer(rules: tuple[Rule, ...], queries: dict[str, set[Clause]], index: DataFrame) -> DataFrame:
    """(doc_id, kinds): for each document that some rule's query holds, those rules' kinds."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("postings"))
    nothing = F.array().cast("array<bigint>")

    def posting(gram: str) -> Column:
        return F.coalesce(F.col("postings")[gram], nothing)

    def ids(clauses: set[Clause]) -> Column:
        either = [reduce(F.array_union, [reduce(F.array_intersect, [posting(g) for g in sorted(a)]) for a in sorted(map(sorted, c))]) for c in sorted(clauses, key=lambda c: sorted(map(sorted, c)))]
        return reduce(F.array_intersect, either)

    asked = [r for r in rules if queries[r.kind]]
    found = F.array(*[F.struct(F.lit(r.kind).alias("kind"), ids(queries[r.kind]).alias("ids")) for r in asked])
    return (
        blocks.select(F.explode(found).alias("f"))
        .select("f.kind", F.explode("f.ids").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """The rule's matches as array<struct<start, ord, kind, end>>: leftmost, non-overlapping, and
    afterwards without those whose group is too short."""
    pattern = F.lit(("(?i)" if rule.ignore_case else "") + rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    rest = F.split(text, pattern.cast("string"), -1)
    sizes = F.transform(F.arrays_zip(rest.alias("r"), matches.alias("m")), lambda x: F.struct(F.length(x["r"]).cast("long").alias("r"), F.length(x["m"]).cast("long").alias("m")))
    if rule.least:
        kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
        sizes = F.transform(F.arrays_zip(sizes.alias("s"), kept.alias("k")), lambda x: F.struct(x["s"]["r"].alias("r"), x["s"]["m"].alias("m"), x["k"].alias("k")))
    span = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["r"]
        end = start + F.coalesce(x["m"], F.lit(0).cast("long"))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))).cast(span)
        keep = x["m"].isNotNull() & (F.coalesce(x["k"], F.lit(False)) if rule.least else F.lit(True))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["found"])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, the text, and `found`, array<struct<start, ord, kind, end>> of
    all rules' matches in code points, in order of their starts, ties by the rules' order; besides these the
    columns of `keep`, which must have other names.

    Null texts are empty; rows without an id are scanned by every rule; repeated rows are scanned each; very
    long texts are scanned whole; an empty table gives an empty table; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for c in q for a in c for g in a})
    if grams:
        blocks = max(1, -(-docs.count() // BLOCK_DOCUMENTS))
        kinds = Scratch(df.sparkSession).write(answer(rules, queries, build_index(docs.select("doc_id", "text"), grams, blocks)), "kinds")
        docs = docs.join(small(kinds), "doc_id", "left")
    else:
        docs = docs.withColumn("kinds", F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    found = []
    for order, r in enumerate(rules):
        spans = spans_of(r, order, F.col("text"))
        asked = (F.array_contains("kinds", r.kind) | F.col("doc_id").isNull()) if queries[r.kind] else F.rlike("text", F.lit(r.pattern))
        found.append(F.when(asked, spans).otherwise(nothing))
    return docs.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"), *keep)


def secret_digest(df: DataFrame) -> DataFrame:
    """The digest columns of `scan_secrets`: counts and listings of base spans and of all spans."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
