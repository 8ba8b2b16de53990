"""Reading programs and answers out of free text, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Phrases that count as declining to answer.
UNRELIABLE_PHRASES = [
    "unreliable", "uncertain", "i don't know", "cannot determine",
    "abstain", "decline", "n/a", "not enough information",
    "insufficient confidence", "low confidence",
]
# Words that mark a text as a program of the query language.
PROGRAM_WORDS = [
    "mean_plddt", "min_plddt", "max_plddt", "std_plddt", "distance", "ca_distance",
    "cb_distance", "seq_separation", "mean_pae", "pae", "n_neighbors", "coordinates",
    "plddt", "sasa", "rel_sasa", "ss", "ref_aa", "residue", "range", "first", "last", "window",
    "all_residues", "sliding_window", "all_pairs", "filter", "exists", "forall", "count",
    "argmin", "argmax", "contact_density", "long_range_contacts", "radius_of_gyration",
    "mean_rel_sasa", "mean_n_neighbors", "protein_length", "n_helices", "n_strands",
    "mean_protein_plddt", "union", "intersection", "difference", "contains", "size",
    "to_set", "in_region", "abs", "min", "max", "round", "floor", "ceil", "between", "runs",
    "longest_run",
]
PROGRAM_KEYS = ["program", "query", "code", "dsl"]
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]
LABEL_WORDS = {
    "H": ["helix", "alpha-helix", "α-helix", "h"],
    "E": ["strand", "beta-strand", "β-strand", "sheet", "e"],
    "C": ["coil", "loop", "c", "-"],
}
NUMBER = r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"
# ------------------------------------------------------------------------------

_SPACE = " \t\n\r\x0b\x0c"
_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(text: Column, extra: str = "") -> Column:
    return F.btrim(text, F.lit(_SPACE + extra))


def _plain(text: Column) -> Column:
    """Trimmed, lower case, without surrounding quotes and full stops."""
    return F.btrim(F.lower(strip(text)), F.lit("\"'."))


def is_unreliable(text: Column) -> Column:
    s = _plain(text)
    hits = [F.contains(s, F.lit(p)) for p in UNRELIABLE_PHRASES]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return F.coalesce(found, F.lit(False))


def parse_numeric(text: Column) -> Column:
    """The first number in the text."""
    return F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")


def parse_bool(text: Column) -> Column:
    s = _plain(text)
    token = strip(F.split_part(s, F.lit(","), F.lit(1)))
    return (
        F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)
        .when(token.isin("yes", "true"), True).when(token.isin("no", "false"), False)
    )


def integers(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda v: v.try_cast("long")
    )


def parse_region(text: Column) -> Column:
    """The first two integers as struct(start, end)."""
    nums = integers(text)
    return F.when(
        F.size(nums) >= 2,
        F.struct(F.get(nums, F.lit(0)).alias("start"), F.get(nums, F.lit(1)).alias("end")),
    )


def parse_label(text: Column) -> Column:
    s = _plain(text)
    out = None
    for letter, words in LABEL_WORDS.items():
        out = (F.when if out is None else out.when)(s.isin(words), letter)
    return out


def strip_reasoning(text: Column) -> Column:
    cut = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(cut, r"(?s)<reasoning>.*?</reasoning>", "")


def looks_like_program(s: Column) -> Column:
    word = r"(?U)\b(" + "|".join(PROGRAM_WORDS) + r")\b"
    return F.contains(s, F.lit("(")) & F.contains(s, F.lit(")")) & s.rlike(word)


def unwrap_json(s: Column, keys=PROGRAM_KEYS) -> Column:
    """The program inside a JSON object, or the trimmed text itself."""
    body = strip(s)
    parsed = F.when(body.startswith("{"), F.try_parse_json(body))
    found = []
    for key in keys:
        item = F.try_variant_get(parsed, f"$.{key}", "variant")
        value = strip(F.try_variant_get(parsed, f"$.{key}", "string"))
        found.append(F.when((F.schema_of_variant(item) == "STRING") & (value != ""), value))
    return F.coalesce(*found, body)


def _first(candidates: Column) -> Column:
    return F.get(F.filter(candidates, lambda c: c.isNotNull()), F.lit(0))


def _accept(s: Column) -> Column:
    return F.when(looks_like_program(s), s)


def trim_outer(s: Column) -> Column:
    """Trim blanks, trailing semicolons and one pair of matching quotes."""
    t = F.regexp_replace(strip(s), r"(?:;\s*)+$", "")
    quoted = (F.length(t) >= 2) & t.rlike(r"""(?s)^(?:'.*'|".*")$""")
    return F.when(quoted, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def extract_program(text: Column) -> Column:
    """The most plausible program in a response, NULL when there is none.

    Fenced blocks come first, then inline code, a bare JSON object, a line
    with a ``program:`` style prefix, and finally any line that reads like a
    program.
    """
    return program_in(strip_reasoning(text))


def program_in(body: Column) -> Column:
    """``extract_program`` of a text without reasoning blocks.  The text is
    named in every step, so it should be a column and no long expression."""

    def fenced(c):
        s = F.btrim(strip(c), F.lit(";"))
        return F.coalesce(_accept(unwrap_json(s)), _accept(s))

    fences = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?s)```(?:[a-zA-Z]*\n)?(.*?)```"), F.lit(1)), fenced
    )
    inline = F.transform(
        F.regexp_extract_all(body, F.lit(r"`([^`\n]+)`"), F.lit(1)),
        lambda c: _accept(F.btrim(strip(c), F.lit(";"))),
    )
    whole = unwrap_json(body)
    bare = F.when(whole != body, _accept(whole))
    prefixed = F.transform(
        F.regexp_extract_all(
            body, F.lit(r"(?imd)(?:program|answer|query)\s*[:=]\s*(.+?)$"), F.lit(1)
        ),
        lambda c: _accept(trim_outer(c)),
    )
    lines = F.transform(F.split(body, _LINE_ENDS), lambda c: _accept(trim_outer(c)))
    return F.coalesce(_first(fences), _first(inline), bare, _first(prefixed), _first(lines))


def _prose_bool(text: Column) -> Column:
    low = F.lower(text)
    yes = F.regexp_instr(low, F.lit(r"(?U)\b(yes|true|correct|present|contains|does)\b"))
    no = F.regexp_instr(low, F.lit(r"(?U)\b(no|false|incorrect|absent|does not|not present)\b"))
    return F.when((yes > 0) & ((no == 0) | (yes < no)), True).when(no > 0, False)


def _prose_label(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"(?U)\bhelix\b") | text.rlike(r"(?U)\bH\b"), "H")
        .when(low.rlike(r"(?U)\b(strand|sheet)\b") | text.rlike(r"(?U)\bE\b"), "E")
        .when(low.rlike(r"(?U)\b(coil|loop)\b") | text.rlike(r"(?U)\bC\b"), "C")
    )


def _region_text(text: Column) -> Column:
    out = []
    for pattern in (r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]", r"(-?\d+)\s*(?:-|to|through)\s*(-?\d+)"):
        a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        out.append(F.when(a != "", F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))))
    nums = F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1))
    two = F.concat(F.lit("["), F.get(nums, F.lit(0)), F.lit(", "), F.get(nums, F.lit(1)), F.lit("]"))
    return F.coalesce(*out, F.when(F.size(nums) >= 2, two))


def _members_text(text: Column) -> Column:
    bracket = F.regexp_extract(text, r"\[([^\]]+)\]", 1)
    source = F.when(bracket != "", bracket).otherwise(text)
    nums = F.regexp_extract_all(source, F.lit(r"(-?\d+)"), F.lit(1))
    return F.when(F.size(nums) > 0, F.concat(F.lit("["), F.array_join(nums, ", "), F.lit("]")))


def response_body(text: Column) -> Column:
    """What of a response is searched: the content of an ``<answer>`` tag if
    there is one, without reasoning blocks."""
    pattern = r"(?s)<answer>\s*(.*?)\s*</answer>"
    tagged = F.contains(text, F.lit("</answer>")) & text.rlike(pattern)
    inner = F.when(tagged, F.regexp_extract(text, pattern, 1)).otherwise(text)
    return strip(strip_reasoning(inner))


def declines(body: Column, answer_type: Column) -> Column:
    """Abstention counts only where the question allows it."""
    selective = F.contains(F.coalesce(answer_type, F.lit("")), F.lit("Unreliable"))
    return F.coalesce(selective & is_unreliable(body), F.lit(False))


def typed_scalar(body: Column, answer_type: Column) -> Column:
    """A value of the wanted type found in prose, as JSON text."""
    base = F.regexp_replace(F.coalesce(answer_type, F.lit("")), r"\|Unreliable", "")
    number = F.regexp_extract(body, f"({NUMBER})", 1)
    return (
        F.when(base == "Bool", F.coalesce(parse_bool(body), _prose_bool(body)).cast("string"))
        .when(base.isin("Int", "Float"), F.when(number != "", number))
        .when(base == "SecStruct", F.coalesce(parse_label(body), _prose_label(body)))
        .when(base == "Region", _region_text(body))
        .when(base == "ResidueSet", _members_text(body))
    )


def tool_call(text: Column) -> Column:
    """struct(name, payload) of the outermost balanced call in an action line.

    Balanced parentheses are not a regular language: the depth after every
    character is a running count, and the payload ends where it returns to 0.
    """
    head = r"(?is)^\s*([a-z_][a-z_0-9]*)\s*\((.*)$"
    name, rest = F.regexp_extract(text, head, 1), F.regexp_extract(text, head, 2)
    # Only positions of parentheses matter; fold over the pieces between them.
    step = F.aggregate(
        F.split(rest, r"(?<=[()])|(?=[()])"),
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)).alias("depth"),
            (s["at"] + F.length(p)).alias("at"),
            F.when((s["end"] < 0) & (p == ")") & (s["depth"] == 1), s["at"]).otherwise(s["end"]).alias("end"),
        ),
        lambda s: s["end"],
    )
    return F.when(
        (name != "") & (step >= 0),
        F.struct(name.alias("name"), F.substring(rest, F.lit(1), step).alias("payload")),
    )


def tool_arguments(payload: Column) -> Column:
    """Comma separated arguments without quotes and keyword names."""
    def clean(p):
        bare = strip(F.btrim(strip(p), F.lit("'\"")))
        value = F.regexp_extract(bare, r"^[^=]*=(.*)$", 1)
        return F.when(F.contains(bare, F.lit("=")), F.btrim(strip(value), F.lit("'\""))).otherwise(bare)

    return F.when(strip(payload) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(payload, ","), clean)
    )
