"""Query expansion: synonyms, criterion contexts, quoted phrases and key concepts, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXTS, SYNONYMS
from ..functions.text import EMPTY_STRINGS, key_concepts


def lookup(table: dict[str, list[str]]) -> Column:
    """A table of fixed values as a map literal."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])


def variants(query: Column, code: Column, concepts: bool = False, most: int = 10) -> Column:
    """The query and its variations, each once (case and outer blanks aside), at most `most`; concepts come after the cap.

    Terms follow the order of the synonym table, as a set's order would differ from run to run.
    """
    lower = F.lower(query)
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\b([a-z]+)\b"), F.lit(1)))
    keys = F.filter(F.array(*[F.lit(k) for k in SYNONYMS]), lambda k: F.array_contains(words, k))
    synonyms, contexts = lookup(SYNONYMS), lookup(CONTEXTS)
    found = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.try_element_at(synonyms, k))))
    absent = lambda terms: F.filter(terms, lambda t: ~lower.contains(t))
    combined = F.when(F.size(found) > 0, F.array(F.concat_ws(" ", query, F.array_join(F.slice(found, 1, 3), " ")))).otherwise(F.expr(EMPTY_STRINGS))
    codes = F.filter(F.transform(F.split(F.upper(F.coalesce(code, F.lit(""))), ","), lambda c: F.trim(c)), lambda c: F.array_contains(F.array(*[F.lit(k) for k in CONTEXTS]), c))
    context = F.flatten(F.transform(codes, lambda c: absent(F.slice(F.try_element_at(contexts, c), 1, 3))))
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    every = F.concat(F.array(query), absent(F.slice(found, 1, 5)), combined, context, quoted)
    plain = F.transform(every, lambda q: F.trim(F.lower(q)))
    kept = F.filter(every, lambda q, i: (F.length(F.get(plain, i)) > 2) & (F.array_position(plain, F.get(plain, i)) == i + 1))
    capped = F.slice(kept, 1, most)
    return F.concat(capped, key_concepts(query)) if concepts else capped


def expanded(queries: DataFrame, concepts: bool = False, longest: int = 500) -> DataFrame:
    """queries: query_id, text, code. query_id, variant, query."""
    text = F.substring("text", 1, longest)
    return queries.select("query_id", F.posexplode(variants(text, F.col("code"), concepts)).alias("variant", "query"))
