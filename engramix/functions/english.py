"""English full text: stop words and a suffix-stripping stemmer.

The stemmer is the published English ("Porter2") algorithm as one SQL expression
that Spark and DuckDB both run: each step finds the longest ending by one regular
expression and replaces it if it lies far enough into the word. No Python runs a
word. ``p`` and ``q`` are where the regions R1 and R2 begin.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: The stop words of the usual English text search configuration.
STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()

#: The published algorithm's irregular words, words left alone, and endings with what replaces them.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
LEFT_ALONE = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
LEFT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def stem_sql(word: str, spark: bool = True) -> str:
    """SQL of the stem of a lower-case word (an expression)."""

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]" if spark else f"list_transform([{value}], lambda {name}: {body})[1]"

    def has(x: str, pattern: str) -> str:
        return f"regexp_like({x}, '{pattern}')" if spark else f"regexp_matches({x}, '{pattern}')"

    def cut(x: str, n: str | int) -> str:
        return f"substring({x}, 1, length({x}) - {n})"

    def ending(x: str, endings) -> str:
        """The longest of the endings that x has, or ''."""
        return f"regexp_extract({x}, '^.*?({'|'.join(endings)})$', 1)"

    def listed(x: str, words) -> str:
        return f"{x} IN ({', '.join(repr(w) for w in words)})"

    marked = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '({_VOWEL})y', '$1Y')" if spark else f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '({_VOWEL})y', '\\1Y', 'g')"
    past = f"^.*?{_VOWEL}{_OTHER}"
    r1 = f"CASE WHEN {has('w', '^(gener|commun|arsen)')} THEN length(regexp_extract(w, '^(gener|commun|arsen)', 1)) WHEN {has('w', past)} THEN length(regexp_extract(w, '{past}', 0)) ELSE length(w) END"
    rest = "substring(w, p + 1, length(w))"
    r2 = f"CASE WHEN {has(rest, past)} THEN p + length(regexp_extract({rest}, '{past}', 0)) ELSE length(w) END"

    def replaced(x: str, endings: dict[str, str], extra: dict[str, str], region: str = "p") -> str:
        """Replace the longest ending if it lies in a region; ``extra``: further conditions by ending."""
        to = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in endings.items() if v)
        more = " ".join(f"WHEN s = '{k}' AND NOT ({c}) THEN {x}" for k, c in extra.items())
        changed = f"concat({cut(x, 'length(s)')}, CASE s {to} ELSE '' END)" if to else cut(x, "length(s)")
        return let("s", ending(x, endings), f"CASE WHEN s = '' OR length({x}) - length(s) < {region} THEN {x} {more} ELSE {changed} END")

    plural = f"CASE WHEN {has('w', 'sses$')} THEN {cut('w', 2)} WHEN {has('w', '(ied|ies)$')} THEN {cut('w', 'CASE WHEN length(w) > 4 THEN 2 ELSE 1 END')} WHEN {has('w', '(us|ss)$')} THEN w WHEN {has('w', _VOWEL + '.+s$')} THEN {cut('w', 1)} ELSE w END"
    mended = f"CASE WHEN {has('t', '(at|bl|iz)$')} THEN concat(t, 'e') WHEN {has('t', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {cut('t', 1)} WHEN p >= length(t) AND {has('t', _SHORT)} THEN concat(t, 'e') ELSE t END"
    stripped = let("t", cut("a", "length(s)"), f"CASE WHEN {has('t', _VOWEL)} THEN {mended} ELSE a END")
    past_forms = let("s", ending("a", ["eedly", "ingly", "edly", "eed", "ing", "ed"]), f"CASE WHEN s = '' THEN a WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(a) - length(s) >= p THEN concat({cut('a', 'length(s)')}, 'ee') ELSE a END ELSE {stripped} END")
    y_to_i = f"CASE WHEN {has('b', f'.{_OTHER}[yY]$')} THEN concat({cut('b', 1)}, 'i') ELSE b END"
    step2 = replaced("c", STEP_2, {"li": has("c", "[cdeghkmnrt]li$"), "ogi": has("c", "logi$")})
    step3 = replaced("d", STEP_3, {"ative": "length(d) - length(s) >= q"})
    step4 = replaced("e", dict.fromkeys(STEP_4, ""), {"ion": has("e", "[st]ion$")}, "q")
    step5 = f"CASE WHEN {has('f', 'e$')} AND (length(f) - 1 >= q OR (length(f) - 1 >= p AND NOT {has(cut('f', 1), _SHORT)})) THEN {cut('f', 1)} WHEN {has('f', 'll$')} AND length(f) - 1 >= q THEN {cut('f', 1)} ELSE f END"
    rest_of = f"replace({step5}, 'Y', 'y')"
    for name, value in (("f", step4), ("e", step3), ("d", step2), ("c", y_to_i), ("b", past_forms)):
        rest_of = let(name, value, rest_of)
    after = let("a", plural, f"CASE WHEN {listed('a', LEFT_AFTER_PLURAL)} THEN a ELSE {rest_of} END")
    whole = let("w", marked, let("p", r1, let("q", r2, after)))
    odd = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    return f"CASE WHEN length({word}) < 3 OR {listed(word, LEFT_ALONE)} THEN {word} WHEN {listed(word, IRREGULAR)} THEN CASE {word} {odd} END ELSE {whole} END"


#: What a word ends in that any rule can change.
_ENDS = "(?:s|ed|ing|y|li|ogi|iti|nci|ion|ism|er|ator|al|ll|ful|e|ant|ent|ic)$"


def stem(word: str) -> Column:
    """Stem of a column of lower-case words, by its name; words with no ending of any rule are left as they are at once."""
    return F.expr(f"CASE WHEN NOT regexp_like({word}, '{_ENDS}') THEN {word} ELSE {stem_sql(word)} END")


def content_words(text: Column) -> Column:
    """Lower-case words of a text without stop words."""
    return F.filter(tx.tokens(text), lambda w: ~w.isin(*STOP))


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """Distinct stems of a query's words without stop words. One row that the driver evaluates, no job."""
    rows = spark.sql("SELECT :q AS q", args={"q": query}).select(F.explode(content_words(F.col("q"))).alias("word"))
    return sorted({r[0] for r in rows.select(stem("word")).collect()})
