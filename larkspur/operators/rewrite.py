"""Rule-based rewriting of queries, as column expressions over a fixed order of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import clean_edges, unique_strings

#: The built-in rules.
TERMS = {"能量工厂": "线粒体", "绿色工厂": "叶绿体"}
SYNONYMS = {"光合作用": "photosynthesis"}
HYPONYMS = {"细胞器": ("线粒体", "叶绿体")}
DERIVED = "化"
MORE = " 详细解释"
MAX_QUERIES = 3


@dataclass(frozen=True)
class RewriteRules:
    terms: tuple[tuple[str, str], ...] = tuple(TERMS.items())
    synonyms: tuple[tuple[str, str], ...] = tuple(SYNONYMS.items())
    hyponyms: tuple[tuple[str, tuple[str, ...]], ...] = tuple(HYPONYMS.items())


def rewrites(query: Column, rules: RewriteRules = RewriteRules(), most: int = MAX_QUERIES) -> Column:
    """Up to ``most`` rewritten queries (0 and less: 3): terms replaced, synonyms added, kinds put for their class."""
    q = clean_edges(F.coalesce(query, F.lit("")))
    has = lambda x: F.contains(q, F.lit(x))
    put = lambda a, b: F.replace(q, F.lit(a), F.lit(b))
    each = [F.when(has(a) & ~has(a + DERIVED), put(a, b)) for a, b in rules.terms]
    each += [F.when(has(a), F.concat(q, F.lit(f" {b}"))) for a, b in rules.synonyms]
    each += [F.when(has(a), put(a, b)) for a, bs in rules.hyponyms for b in bs]
    found = unique_strings(F.filter(F.array(*each) if each else F.array().cast("array<string>"), lambda x: x.isNotNull()))
    return F.slice(found, 1, most if most > 0 else MAX_QUERIES)


def second_tries(query: Column, rules: RewriteRules = RewriteRules(), most: int = MAX_QUERIES) -> Column:
    """What an uncertain result is searched by again: the rewrites, or the query asking for more where there are none."""
    found = rewrites(query, rules, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(clean_edges(F.coalesce(query, F.lit(""))), F.lit(MORE))))


def query_set(query: Column, rules: RewriteRules = RewriteRules(), most: int = MAX_QUERIES) -> Column:
    """The query and its rewrites, each once."""
    return unique_strings(F.concat(F.array(clean_edges(query)), rewrites(query, rules, most)))


def expand_queries(queries: DataFrame, rules: RewriteRules = RewriteRules(), most: int = MAX_QUERIES) -> DataFrame:
    """query_id, variant (from 0), query: a row for each query of each set."""
    return queries.select("query_id", F.posexplode(query_set(F.col("query"), rules, most)).alias("variant", "query"))
