"""Extraction of alloys, properties, phases and temperature ranges from texts, by rules or templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import WORD, strip

_S = r"[\s\x1c-\x1f]"
_D = r"\p{Nd}"
#: A number that gives nothing back; a match that takes one starts at the first of its digits.
_N = rf"{_D}++(?:\.{_D}*+)?+"
_NAME = rf"[\p{{L}}\p{{N}}_\s\x1c-\x1f]"
_END = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_ELEMENT = r"(?:[A-Z][a-z]?+)?+"
#: A part of an alloy's name: a number and perhaps an element, tokens that give nothing back.  It is
#: taken whole if no word character follows; else up to its point, if a word or a part that can end
#: follows that; else up to before the point.
_WHOLE = rf"-{_N}{_ELEMENT}(?<={WORD})(?!{WORD})"
_POINT = rf"-{_D}++\.(?={WORD}|-{_D}++(?:\.|{_ELEMENT}(?!{WORD})))"
_BARE = rf"-{_D}++(?=\.)"
_FACT = rf"({_NAME}+?)(?:[:=]{_S}*| is{_S}+| of{_S}+)({_D}+\.?{_D}*){_S}*([°%/³²·\p{{L}}\p{{N}}_]+)"
#: What the patterns accept.  Each character class stands alone in its loop and every
#: attempt starts where a run of names or digits starts, so time is linear and nothing recurses.
ALLOY = rf"(?<!{WORD})([A-Z][a-z]?+(?:{_WHOLE}|{_POINT}|{_BARE})++)"
PROPERTY = rf"(?U)(?:(?<!{_NAME})|\G){_FACT}"
RANGE = rf"(?U)(?<!{_D})({_N}){_S}*[–\-]{_S}*({_N}){_S}*(°[CF]|K)"
PHASE = rf"(?iuU)(?<!{WORD})(?=\w|[γαβδ])(?:γ|α|β|δ|BCC|FCC|HCP){_S}*(?:phase|U|structure)?{_END}"
PERCENT = rf"(?<!{_D})({_N})[\s\x1c-\x1f]*(wt%|at%|vol%|mol%)"
#: What no fact goes across, and what stands before its number.
_BORDER = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f:=.°%/³²·]"
_HINT = rf"(?U)(?:[:=]{_S}*| is{_S}+| of{_S}+){_D}"
#: Properties and their keywords, in order.
KEYWORDS = {
    "density": ["density", "ρ", "mass density"],
    "melting_point": ["melting point", "Tm", "melting temperature"],
    "thermal_conductivity": ["thermal conductivity", "κ", "k", "λ"],
    "specific_heat": ["specific heat", "Cp", "heat capacity"],
    "thermal_expansion": ["thermal expansion", "CTE", "α", "coefficient of thermal expansion"],
    "yield_strength": ["yield strength", "σy", "YS"],
    "tensile_strength": ["tensile strength", "ultimate tensile", "UTS", "σu"],
    "elastic_modulus": ["elastic modulus", "Young's modulus", "E"],
    "hardness": ["hardness", "HB", "HV", "HRC"],
    "diffusivity": ["diffusion coefficient", "diffusivity", "D"],
    "swelling": ["swelling", "ΔV/V", "volume change"],
    "irradiation": ["irradiation", "fluence", "dpa", "displacement"],
    "conductivity_electrical": ["electrical conductivity", "resistivity", "ρe"],
    "corrosion_rate": ["corrosion rate", "corrosion resistance"],
}


def classify(name: Column) -> Column:
    """The first property with a keyword in the (lower-case) name, else null; keywords with capitals never match."""
    out = F
    for prop, words in KEYWORDS.items():
        test = F.lit(False)
        for w in words:
            test = test | F.contains(name, F.lit(w))
        out = out.when(test, prop)
    return out


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _groups(match: Column, pattern: str, *numbers: int) -> list[Column]:
    """Groups of a match's own text: the long text is searched once."""
    return [F.regexp_extract(match, pattern, n) for n in numbers]


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def composition(name: Column) -> Column:
    """Element -> percentage of parts that begin with an element and a number; the first part's element takes the rest."""
    def pairs_of(parts: Column) -> Column:
        own = F.filter(parts, lambda p: p.rlike(rf"\A[A-Z][a-z]?{_D}"))
        pairs = F.transform(own, lambda p: F.struct(F.regexp_extract(p, r"\A([A-Z][a-z]?)", 1).alias("element"), F.regexp_extract(p, rf"\A[A-Z][a-z]?({_N})", 1).cast("double").alias("share")))
        return F.struct(pairs.alias("pairs"), F.regexp_extract(F.get(parts, F.lit(0)), r"\A([A-Z][a-z]?)", 1).alias("base"))

    def shares(x: Column) -> Column:
        pairs, base = x["pairs"], x["base"]
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["share"])
        lasting = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["element"] == p["element"]))
        known = F.exists(pairs, lambda p: p["element"] == base)
        rest = F.when((F.size(pairs) > 0) & (total < 100) & (base != "") & ~known, F.array(F.struct(base.alias("element"), (F.lit(100.0) - total).alias("share")))).otherwise(F.array().cast("array<struct<element:string,share:double>>"))
        return F.map_from_entries(F.concat(lasting, rest))

    return _once(_once(F.split(name, "-"), pairs_of), shares)


def alloys(text: Column) -> Column:
    """Distinct alloy names in the order of their first place."""
    names = F.filter(F.array_distinct(_all(text, ALLOY, 1)), lambda n: F.length(n) >= 3)
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Alloy").alias("type"), composition(n).alias("composition"), F.lit(0.8).alias("extraction_confidence")))


def properties(text: Column) -> Column:
    """Numeric properties with a known name."""
    whole = rf"(?U)\A{_FACT}\z"

    def named(match: Column) -> Column:
        raw = F.lower(strip(F.regexp_extract(match, whole, 1)))
        return F.struct(match.alias("context"), raw.alias("raw"))

    def judged(m: Column) -> Column:
        return F.struct(classify(m["raw"]).alias("name"), m["raw"].alias("raw"), m["context"].alias("context"))

    def fact(m: Column) -> Column:
        number, unit = _groups(m["context"], whole, 2, 3)
        return F.struct(m["name"].alias("name"), number.try_cast("double").alias("value"), strip(unit).alias("unit"), m["raw"].alias("raw_name"), m["context"].alias("context"))

    pieces = F.filter(F.split(text, _BORDER), lambda p: p.rlike(_HINT))  # few: the rest of the text is read once, by plain classes
    matches = F.flatten(F.transform(pieces, lambda p: _all(p, PROPERTY)))
    known = F.filter(F.transform(F.transform(matches, named), judged), lambda m: m["name"].isNotNull())  # a step each: a raw name is computed once, not for each keyword
    empty = F.array().cast("array<struct<name:string,value:double,unit:string,raw_name:string,context:string>>")
    return F.when(~text.rlike(r"\p{Nd}"), empty).otherwise(F.transform(known, fact))


def phases(text: Column) -> Column:
    """Phases as written, without the word phase."""
    rows = F.transform(_all(text, PHASE, 0), lambda m: F.struct(F.lit("phase").alias("type"), strip(F.replace(F.replace(strip(m), F.lit("phase"), F.lit("")), F.lit("Phase"), F.lit(""))).alias("phase"), m.alias("context")))
    return F.filter(rows, lambda p: p["phase"] != "")


def temperatures(text: Column) -> Column:
    def span(match: Column) -> Column:
        low, high, unit = _groups(match, RANGE, 1, 2, 3)
        return F.struct(low.try_cast("double").alias("min"), high.try_cast("double").alias("max"), unit.alias("unit"))

    return F.transform(_all(text, RANGE), span)


def percentages(text: Column) -> Column:
    def share(match: Column) -> Column:
        value, unit = _groups(match, PERCENT, 1, 2)
        return F.struct(value.try_cast("double").alias("value"), unit.alias("unit"))

    return F.transform(_all(text, PERCENT), share)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A result per text: individuals, properties, relationships, temperature_ranges, text_length, total_items.

    Narrow.  A null text counts as empty.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    t = F.col("__t")
    out = rows.select(id_col, alloys(t).alias("individuals"), properties(t).alias("properties"), phases(t).alias("relationships"), temperatures(t).alias("temperature_ranges"), F.length(t).alias("text_length"))
    return out.withColumn("total_items", F.size("individuals") + F.size("properties") + F.size("relationships"))


def records(results: DataFrame) -> DataFrame:
    """Results of ``extract`` as records: source, individuals, properties, relationships, total_items, metadata.

    The source is the results' first column as text (``unknown`` if null); metadata has the method,
    the text's length and its temperature ranges.
    """
    source = F.coalesce(F.col(results.columns[0]).cast("string"), F.lit("unknown")).alias("source")
    metadata = F.struct(F.lit("rule-based").alias("method"), "text_length", "temperature_ranges").alias("metadata")
    return results.select(source, "individuals", "properties", "relationships", "total_items", metadata)


def extract_with_template(docs: DataFrame, template: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A user's patterns per property: a pattern, a list, or {"patterns": [...]}; patterns without groups give nothing.

    Returns id, name, value (array: one string per group), is_scalar, context, position.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    patterns = {name: [p] if isinstance(p, str) else list(p.get("patterns", [])) if isinstance(p, dict) else list(p) for name, p in template.items()}

    def run(batches):
        import re

        import pandas as pd

        compiled = [(name, re.compile(p, re.IGNORECASE)) for name, own in patterns.items() for p in own]
        for pdf in batches:
            rows = [(key, name, list(m.groups()), len(m.groups()) == 1, m[0], m.start()) for key, text in zip(pdf[id_col], pdf[text_col]) for name, p in compiled for m in p.finditer(text or "") if m.groups()]
            yield pd.DataFrame(rows, columns=[id_col, "name", "value", "is_scalar", "context", "position"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, name string, value array<string>, is_scalar boolean, context string, position int")
