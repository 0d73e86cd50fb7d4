"""Comparable text, vocabularies and payload access, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the one ASCII letter that their compatibility decomposition leaves; marks by themselves, which come last, count as nothing.
_FOLDS = {c: p for c in map(chr, range(0xA1, 0x2000)) if len(p := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()) == 1 and p.isalnum()} | {"°": "o"}
MARKED = "".join(_FOLDS) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_FOLDS.values())


def folded(text: Column) -> Column:
    """Lower case, trimmed, without accents, single spaces; ordinal letters stay."""
    return F.regexp_replace(F.translate(F.lower(F.trim(text)), MARKED, PLAIN), " +", " ")


def comparable(text: Column) -> Column:
    """folded(), without the letter after a number: `1ª Cia`, `1a Cia` and `1 Cia` are equal."""
    return F.regexp_replace(folded(text), r"([0-9]+)[ao]\b", "$1")


def vocabulary(text: Column, values: dict[str, list[str]]) -> Column:
    """The canonical value whose name or synonym the trimmed text is, whatever its case; null if none is."""
    known = {s.lower(): name for name, synonyms in reversed(values.items()) for s in [*synonyms, name]}
    keys = sorted(known)
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, known[k])]) if keys else F.lit(None)
    return F.try_element_at(table, F.lower(F.trim(text))) if keys else F.lit(None).cast("string")


def vocabulary_or_word(text: Column, values: dict[str, list[str]], elsewhere: Column, words: list[str]) -> Column:
    """vocabulary(); where it is null, the value of the first of the given words that another text holds as a whole word, plural or not."""
    known = {s.lower(): name for name, synonyms in reversed(values.items()) for s in synonyms}
    unknown = [w for w in words if w.lower() not in known]
    if unknown:
        raise ValueError(f"not synonyms of the vocabulary: {unknown}")
    found = None
    for w in words:
        hit = F.lower(elsewhere).rlike(r"\b" + re.escape(w.lower()) + r"s?\b")
        found = F.when(hit, F.lit(known[w.lower()])) if found is None else found.when(hit, F.lit(known[w.lower()]))
    return vocabulary(text, values) if found is None else F.coalesce(vocabulary(text, values), found)


def shown(value: Column, names: dict[str, str]) -> Column:
    """The display form of a value, itself where none is declared."""
    if not names:
        return value
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def listing(values: Column, names: dict[str, str] | None = None) -> Column:
    """Sorted distinct values in display form, joined by commas; null if there are none."""
    return F.nullif(F.array_join(F.transform(F.array_sort(F.array_distinct(values)), lambda x: shown(x, names or {})), ", "), F.lit(""))


def first_of(*alternatives: Column) -> Column:
    return F.coalesce(*alternatives)


def composed(*parts: Column, by: str = "_") -> Column:
    """The parts that aren't null, joined."""
    return F.concat_ws(by, *parts)


def integer(cell: Column) -> Column:
    """A text cell as int; a decimal is cut, other text is null."""
    return cell.try_cast("double").try_cast("int")


def payload_map(json_text: Column) -> Column:
    """A JSON object as map<string,string>; nested values stay JSON text."""
    return F.from_json(json_text, "map<string,string>")


def leftover(cells: Column, declared: list[str]) -> Column:
    """JSON of the cells that no declared column names, null if there are none."""
    rest = F.map_filter(cells, lambda k, v: ~k.isin(*declared) & v.isNotNull()) if declared else F.map_filter(cells, lambda k, v: v.isNotNull())
    return F.when(F.size(rest) > 0, F.to_json(rest))


def one_line(text: Column, most: int = 300) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, most)


def weapon(text: Column, part: int) -> Column:
    """Part 1 to 3 of a leading `quantity/kind/calibre`, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+)\s*/\s*([A-Za-z]+)\s*/\s*([A-Za-z]+)", part), F.lit(""))


def event_id(source: Column, record: Column, occurred: Column) -> Column:
    """The identity of an event: digest of source, original record and time in UTC; nulls are skipped."""
    return F.sha2(F.concat_ws("|", source, record, occurred), 256)
