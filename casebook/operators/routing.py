"""Keyword routing.

A router config maps domain -> (keywords, agent_id).  A config of a few keywords becomes one
``rlike`` per domain inside a single projection: no join, no UDF, whole texts scanned by the
JVM regex engine.  That costs a scan per domain and an attempt per keyword and position, so a
config with more than ``REGEX_KEYWORDS`` keywords becomes one Aho-Corasick automaton instead: an
Arrow map walks every text once, whatever the number of keywords, and checks word
boundaries at the hits.  Both forms give the same agents.

Word boundaries are Unicode-aware: a keyword matches when it is not preceded or followed
by a letter, digit or underscore (what Python's ``\\b`` means for keywords that start and
end with word characters).  Keywords are quoted (``\\Q...\\E``) so they match literally.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: Configs with more keywords are matched by an automaton.
REGEX_KEYWORDS = 200


@dataclass(frozen=True)
class Domain:
    name: str
    keywords: tuple[str, ...]
    agent_id: str | None


# The router config used by the registered queries.  The reference ships
# no keyword map, so this one is ours; it contains an accented keyword (Unicode word
# boundaries), a domain without agent (hits nothing) and one without keywords (dropped).
DEFAULT_ROUTES = (
    Domain("cardio", ("the", "heart failure", "chest pain"), "1"),
    Domain("gi", ("les", "abdominal pain", "heartburn"), "2"),
    Domain("musculo", ("und", "knee injury", "ankle pain"), "3"),
    Domain("neuro", ("été", "los"), "4"),
    Domain("orphan", ("de",), None),
    Domain("empty", ("",), "5"),
)


def quote(kw: str) -> str:
    return "\\Q" + kw.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def domain_pattern(domain: Domain) -> str | None:
    """Java regex for one domain, or None when it has no usable keyword."""
    kws = [quote(k) for k in domain.keywords if k]
    if not kws:
        return None
    return f"(?iu)(?<!{WORD})(?:{'|'.join(kws)})(?!{WORD})"


def usable(routes) -> list[Domain]:
    return [d for d in routes if domain_pattern(d) is not None]


def route_expr(text: Column, routes=DEFAULT_ROUTES) -> Column:
    """Sorted distinct agent ids whose domain keywords occur in ``text``.

    Empty / null text -> empty array; a matched domain without agent adds nothing.
    """
    hits = [F.when(text.rlike(domain_pattern(d)), F.lit(d.agent_id))
            for d in usable(routes) if d.agent_id]
    if not hits:
        return F.array().cast("array<string>")
    arr = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0,
                  F.array().cast("array<string>")).otherwise(arr)


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    """Characters that compare equal to another one when case is ignored, as the regex engine does it:
    through the upper and then the lower case of single characters."""
    out = {0x130: "i"}          # its own lower case has two characters here, one in the regex engine
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        if len(low) == 1 and low != c:
            out[i] = low
    return out


class _Plain(dict):
    """character -> does its folding equal ``str.lower`` wherever it stands?  (A capital sigma's lower
    case depends on its place.)"""

    def __missing__(self, c: str) -> bool:
        plain = self[c] = c != "\u03a3" and c.lower() == _folds().get(ord(c), c)
        return plain


_plain = _Plain()


def fold_case(text: str) -> str:
    """The text with every character folded on its own: its length does not change."""
    if text.isascii() or all(map(_plain.__getitem__, set(text))):
        return text.lower()
    return text.translate(_folds())


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


class KeywordAutomaton:
    """Aho-Corasick automaton over the folded keywords of a config: text -> sorted agent ids."""

    def __init__(self, routes: tuple[Domain, ...]):
        import ahocorasick
        agents: dict[str, set] = {}
        for d in usable(routes):
            if d.agent_id:
                for k in filter(None, d.keywords):
                    agents.setdefault(fold_case(k), set()).add(d.agent_id)
        self.walk = ahocorasick.Automaton()
        for k, found in agents.items():
            self.walk.add_word(k, (len(k), frozenset(found)))
        if agents:
            self.walk.make_automaton()
        self.any = bool(agents)
        self.all = frozenset().union(*agents.values())

    def agents(self, text: str | None) -> list[str]:
        if not text or not self.any:
            return []
        low, found = fold_case(text), set()
        for end, (size, ids) in self.walk.iter(low):
            first, after = end - size + 1, end + 1
            if not ids <= found and not (first and _is_word(low[first - 1])) \
                    and not (after < len(low) and _is_word(low[after])):
                found |= ids
                if len(found) == len(self.all):        # no later hit can add an agent
                    break
        return sorted(found)


@lru_cache(maxsize=4)
def automaton(routes: tuple[Domain, ...]) -> KeywordAutomaton:
    return KeywordAutomaton(routes)


def automaton_udf(routes: tuple[Domain, ...]):
    """Column function text -> agents; the config travels with it, the automaton is built once per
    worker."""
    @F.pandas_udf("array<string>")
    def agents(texts: pd.Series) -> pd.Series:
        find = automaton(routes).agents
        return pd.Series([find(t) for t in texts], dtype=object)

    return agents


def routes_from(keywords: DataFrame) -> tuple[Domain, ...]:
    """A config from a table (domain, keyword, agent_id): settings, not data, held by the driver."""
    rows = keywords.select("domain", "keyword", "agent_id").distinct().collect()
    found: dict = {}
    for r in rows:
        found.setdefault((r["domain"], r["agent_id"]), []).append(r["keyword"])
    return tuple(Domain(d, tuple(sorted(k for k in ks if k)), a)
                 for (d, a), ks in sorted(found.items(), key=str))


def route(notes: DataFrame, text_col: str = "text", routes=DEFAULT_ROUTES,
          partitions: int | None = None) -> DataFrame:
    """Adds ``agents`` (array<string>) to every row.  ``partitions`` deals the rows out first: for
    few large files whose row groups are fewer than the cores."""
    if partitions:
        notes = notes.repartition(partitions)
    if sum(len(d.keywords) for d in usable(routes)) > REGEX_KEYWORDS:
        from casebook.session import reach_workers
        reach_workers(notes.sparkSession)
        return notes.withColumn("agents", automaton_udf(tuple(routes))(F.col(text_col)))
    from casebook.functions.columns import cached_expr
    expr = cached_expr(("route", text_col, tuple(routes)),
                       lambda: route_expr(F.col(text_col), routes))
    return notes.withColumn("agents", expr)


def route_summary(routed: DataFrame, id_col: str = "note_id") -> DataFrame:
    """label, n: notes per agent, plus 'multi_routed' and 'unrouted' totals."""
    per_agent = (routed.select(F.explode("agents").alias("label"))
                 .groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    totals = routed.agg(F.count(F.when(F.size("agents") > 1, 1)).alias("multi_routed"),
                        F.count(F.when(F.size("agents") == 0, 1)).alias("unrouted"))
    extra = totals.select(F.explode(F.array(
        F.struct(F.lit("multi_routed").alias("label"), F.col("multi_routed").alias("n")),
        F.struct(F.lit("unrouted").alias("label"), F.col("unrouted").alias("n")))).alias("s")
    ).select("s.label", "s.n")
    return per_agent.unionByName(extra).select("label", F.col("n").cast("long").alias("n"))


def fan_out(routed: DataFrame, answers: DataFrame, id_col: str = "note_id",
            case_col: str = "case_id") -> DataFrame:
    """One row per (case, selected agent) that has a stored answer (T3, inner join)."""
    sel = routed.select(F.col(id_col).alias(case_col), F.explode("agents").alias("agent_id"))
    return sel.join(answers, [case_col, "agent_id"], "inner")
