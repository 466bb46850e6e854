"""Russian stemmer as a chain of Catalyst expressions.

Endings are taken off at or behind the first vowel, longest first.  Stems are a
function of the word alone, so ``with_stems`` computes them once per
distinct word and joins them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings by group.
GERUND_AFTER_A = ("вшись", "вши", "в")
GERUND = ("вшись", "вши", "ив", "ыв")
ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом",
    "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
PARTICIPLE_AFTER_A = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_AFTER_A = ("нно", "ешь", "йте", "ла", "на", "ете", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть")
VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено",
    "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ешь", "ую", "ю", "ете", "ет", "ут",
)
NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям",
    "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
DERIVATIONAL = ("ость", "ост")
SUPERLATIVE = ("ейше", "ейш")
VOWELS = "аеиоуыэюя"
UPPER = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁё"
LOWER = "абвгдежзийклмнопрстуфхцчшщъыьэюяее"

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
_IN_RV = rf"(?s)^({_C}*{_V}.*?)"
_AFTER_A = rf"(?s)^({_C}*[ая]|{_C}*{_V}.*?[ая])"
_TWO = tuple(e for e in ADJECTIVE if len(e) == 2)


def _any(endings: tuple[str, ...]) -> str:
    return "(?:" + "|".join(endings) + r")\z"


#: Named removals, each a pattern whose first group is what stays.
PATTERNS = {
    "gerund_after_a": _AFTER_A + _any(GERUND_AFTER_A),
    "gerund": _IN_RV + _any(GERUND),
    "reflexive": _IN_RV + _any(REFLEXIVE),
    "participle_pair": _AFTER_A + "(?:" + "|".join(p for p in PARTICIPLE_AFTER_A if len(p) == 2) + ")" + _any(_TWO),
    "participle_single": _IN_RV + "[ая]щ." + _any(("я",)),
    "participle": _IN_RV + _any(PARTICIPLE),
    "adjective": _IN_RV + _any(ADJECTIVE),
    "verb_after_a": _AFTER_A + _any(VERB_AFTER_A),
    "verb": _IN_RV + _any(VERB),
    "noun": _IN_RV + _any(NOUN),
    "final_i": rf"(?s)^({_C}*{_V}.*)и\z",
    "superlative": _IN_RV + _any(SUPERLATIVE),
    "undouble": r"(?s)^(.*н)н\z",
    "soft_sign": r"(?s)^(.*)ь\z",
}
_R2 = rf"^{_C}*{_V}*{_C}*{_V}*"


def _steps(cut, first, other, if_other, longer, derive) -> list:
    """The chain of named values, over primitives of the host language.

    Each value is a function of those before it, given by name.  cut(name, x)
    removes an ending, other(a, b) is a unless it equals b, first(...) the first
    value there is, if_other(a, b, c) is c unless a equals b, longer(x, n, a) is a
    for words of n letters or more.
    """

    def ending(v):
        w, f = v["w"], v["f"]
        bare = cut("participle", f)
        return first(
            other(cut("gerund_after_a", w), w),
            other(cut("gerund", w), w),
            longer(f, 6, other(cut("participle_pair", f), f)),
            longer(f, 5, other(cut("participle_single", f), f)),
            if_other(bare, f, other(cut("adjective", bare), bare)),
            other(cut("adjective", f), f),
            other(cut("verb_after_a", f), f),
            other(cut("verb", f), f),
            cut("noun", f),
        )

    return [
        ("f", lambda v: cut("reflexive", v["w"])),
        ("i", lambda v: cut("final_i", ending(v))),
        ("d", lambda v: derive(v["i"], v["w"])),
        ("s", lambda v: cut("superlative", v["d"])),
        ("e", lambda v: first(if_other(v["s"], v["d"], cut("undouble", v["s"])), cut("soft_sign", cut("undouble", v["s"])))),
    ]


def stem(word: Column) -> Column:
    """Stem of a word.  Each value of the chain is bound once, so the plan stays linear."""

    def derive(i: Column, w: Column) -> Column:
        r2, size = F.char_length(F.regexp_extract(w, _R2, 0)), F.char_length(i)
        long, short = i.endswith(DERIVATIONAL[0]) & (size - 4 >= r2), i.endswith(DERIVATIONAL[1]) & (size - 3 >= r2)
        return F.when(long, i.substr(F.lit(1), size - 4)).when(short, i.substr(F.lit(1), size - 3)).otherwise(i)

    chain = _steps(
        cut=lambda name, x: F.regexp_replace(x, PATTERNS[name], "$1"),
        first=F.coalesce,
        other=F.nullif,
        if_other=lambda a, b, c: F.when(a != b, c),
        longer=lambda x, n, a: F.when(F.char_length(x) >= n, a),
        derive=derive,
    )

    def bind(values: dict, at: int) -> Column:
        if at == len(chain):
            return F.when((F.char_length(word) < 4) | ~values["e"].rlike(_V), word).otherwise(values["e"])
        name, make = chain[at]
        return F.get(F.transform(F.array(make(values)), lambda x: bind(values | {name: x}, at + 1)), F.lit(0))

    chained = F.get(F.transform(F.array(F.translate(word, UPPER, LOWER)), lambda w: bind({"w": w}, 0)), F.lit(0))
    # a word without Russian vowels has no ending to lose
    return F.when(F.translate(word, UPPER, LOWER).rlike(_V), chained).otherwise(word)


def stem_terms(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """``words`` with the stem of each word; null words stay null."""
    return words.withColumn(name, stem(F.col(word)))


def with_stems(terms: DataFrame, term: str = "term", name: str = "stem") -> DataFrame:
    """``terms`` with stems, computed once per distinct word; only words that stemming changes are met in the join."""
    known = stem_terms(terms.select(F.col(term).alias("__word")).distinct(), "__word", "__stem").where("__stem <> __word")
    return terms.join(known, F.col(term) == F.col("__word"), "left").withColumn(name, F.coalesce("__stem", term)).drop("__word", "__stem")


def stem_word(word: str) -> str:
    """The same chain for one word, outside a plan (SQL registration)."""
    import re

    import_pattern = {k: re.compile(p.replace(r"\z", r"\Z")) for k, p in PATTERNS.items()}

    def derive(i, w):
        r2 = len(re.match(_R2, w)[0]) if re.match(_R2, w) else 0
        for e in DERIVATIONAL:
            if i.endswith(e) and len(i) - len(e) >= r2:
                return i[: -len(e)]
        return i

    chain = _steps(
        cut=lambda name, x: None if x is None else import_pattern[name].sub(r"\1", x),
        first=lambda *x: next((v for v in x if v is not None), None),
        other=lambda a, b: None if a == b else a,
        if_other=lambda a, b, c: c if a is not None and b is not None and a != b else None,
        longer=lambda x, n, a: a if len(x) >= n else None,
        derive=derive,
    )
    values = {"w": word.translate(str.maketrans(UPPER, LOWER))}
    if len(word) < 4 or not re.search(_V, values["w"]):
        return word
    for name, make in chain:
        values[name] = make(values)
    return values["e"] if re.search(_V, values["e"]) else word


def sql_chain(words: str) -> str:
    """The same chain as SQL over a relation ``words(word)``: common table expressions ending in stems(word, stem)."""

    def derive(i: str, w: str) -> str:
        r2 = f"length(regexp_extract({w}, '{_R2}', 0))"
        cases = "".join(f" WHEN {i} LIKE '%{e}' AND length({i}) - {len(e)} >= {r2} THEN left({i}, length({i}) - {len(e)})" for e in DERIVATIONAL)
        return f"CASE{cases} ELSE {i} END"

    chain = _steps(
        cut=lambda name, x: f"regexp_replace({x}, '{PATTERNS[name]}', '\\1')",
        first=lambda *x: f"coalesce({', '.join(x)})",
        other=lambda a, b: f"nullif({a}, {b})",
        if_other=lambda a, b, c: f"CASE WHEN {a} <> {b} THEN {c} END",
        longer=lambda x, n, a: f"CASE WHEN length({x}) >= {n} THEN {a} END",
        derive=derive,
    )
    names = {"w": "w"} | {name: name for name, _ in chain}
    parts = [f"s0 AS (SELECT word, translate(word, '{UPPER}', '{LOWER}') AS w FROM {words})"]
    parts += [f"s{k + 1} AS (SELECT *, {make(names)} AS {name} FROM s{k})" for k, (name, make) in enumerate(chain)]
    parts.append(f"stems AS (SELECT word, CASE WHEN length(word) < 4 OR NOT regexp_matches(e, '{_V}') THEN word ELSE e END AS stem FROM s{len(chain)})")
    return ", ".join(parts)


def is_vowel(c: Column) -> Column:
    return c.rlike(rf"^[{VOWELS}ё]\z")
