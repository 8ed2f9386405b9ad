"""Tactic text: anchors, white space, the abstracting normaliser and tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import WHITE, tokens

#: Words of the tactic language, never abstracted.
KEYWORDS = sorted({
    "simp", "ring", "linarith", "omega", "norm_num", "norm_cast", "push_cast", "decide", "trivial", "tauto", "aesop", "positivity", "gcongr",
    "polyrith", "constructor", "rfl", "exact", "apply", "rw", "rewrite", "simp_rw", "intro", "intros", "rintro", "ext", "ext1", "ext2", "funext",
    "congr", "convert", "use", "left", "right", "cases", "rcases", "obtain", "induction", "by_cases", "by_contra", "contrapose", "exfalso",
    "contradiction", "assumption", "split_ifs", "split", "subst", "clear", "have", "suffices", "show", "change", "refine", "dsimp", "simp_all",
    "ring_nf", "field_simp", "revert", "generalize", "specialize", "replace", "fin_cases", "interval_cases", "mod_cast", "classical", "haveI", "letI",
    "inferI", "infer_instance", "this", "fun", "swap", "abel", "group", "linear_combination", "with", "at", "only", "using", "all_goals", "any_goals",
    "first", "try", "repeat", "iterate", "push_neg", "contrapose!", "by_contra!", "and", "or", "not", "cases'", "induction'", "assumption'",
    "simp_all_arith", "rotate_left", "rotate_right", "substs", "norm_fin", "norm_int", "pull_neg", "module_cast", "simp?", "exact?", "apply?", "rw?",
    "tfae_have", "tfae_finish", "calc", "conv", "conv_lhs", "conv_rhs", "ring1", "set",
})
#: Tactics that say nothing about a proof's strategy.
GENERIC = [
    "simp", "intro", "exact", "apply", "rfl", "ring", "norm_num", "linarith", "omega", "decide", "trivial", "tauto", "aesop", "constructor", "use",
    "left", "right", "ext", "congr", "push_neg", "contrapose", "by_contra", "by_cases",
]

ANCHOR = r"(?d)<a>(.*?)</a>"
_WORD = r"[\p{L}\p{N}_]"
#: A word boundary where subscript digits and letters of any script count as word characters.
_B = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def anchors(c: Column | str) -> Column:
    """Contents of every ``<a>..</a>``, shortest first; a line break ends none."""
    return F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(1))


def stripped(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE + "\x1c\x1d\x1e\x1f"))


def without_anchors(c: Column | str) -> Column:
    """Anchors replaced by their contents, trimmed."""
    return stripped(F.regexp_replace(c, ANCHOR, "$1"))


def collapsed(c: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    white = WHITE.replace(" ", "") + "\x1c\x1d\x1e\x1f"
    return F.array_join(F.array_remove(F.split(F.translate(c, white, " " * len(white)), " "), ""), " ")


def normalised(c: Column | str) -> Column:
    """A tactic with names abstracted: qualified or long names to ``@``, short identifiers to ``?``, numbers to ``#``.

    Each rule sees what the one before left. A keyword stays where it is the whole of what the rule matched: the lookahead
    takes the rest of the text after the longest match, and a keyword followed by that rest is the match itself.
    """
    kept = "|".join(sorted(map(re.escape, KEYWORDS), key=len, reverse=True))

    def unless_keyword(body: str) -> str:
        return rf"(?s){_B}(?=(?>{body}{_B})(.*)\z)(?!(?:{kept})\1\z){body}{_B}"

    out = collapsed(c)
    # fixed values: what a qualified or long name, a name with underscores, a short identifier and a number are
    out = F.regexp_replace(out, rf"{_B}(?:[A-Za-z][A-Za-z0-9_']*(?:\.[A-Za-z0-9_']+)+|[A-Z][A-Za-z0-9_']{{3,}}){_B}", "@")
    out = F.regexp_replace(out, unless_keyword(r"[a-z][a-z0-9']*(?:_[a-z0-9']+)+"), "@")
    out = F.regexp_replace(out, unless_keyword(r"[a-z][a-z0-9']{0,3}"), "?")
    return F.regexp_replace(out, rf"{_B}\p{{Nd}}+{_B}", "#")


def all_generic(gram: Column | str) -> Column:
    """True if the first word of every element is a generic tactic."""
    return F.forall(gram, lambda x: F.split(x, " ", 2)[0].isin(GENERIC))


def token_stream(tactics: Column | str) -> Column:
    """Tokens of a list of tactics, across the tactics' ends."""
    return F.flatten(F.transform(tactics, tokens))


def sql_collapsed(e: str) -> str:
    white = (WHITE.replace(" ", "") + "\x1c\x1d\x1e\x1f").replace("'", "''")
    return f"array_to_string(list_filter(string_split(translate({e}, '{white}', '{' ' * len(white)}'), ' '), lambda x: x <> ''), ' ')"


def sql_normalised(e: str) -> str:
    """``normalised`` in SQL without lookaround: every word boundary gets two marks, of which a match takes the second at its
    start and the first at its end, so neighbours can share one. Each rule cuts the marked text to its matches and single
    characters, which are replaced one by one."""
    s, k = "(?:\x01\x02)?", ", ".join("'" + w.replace("'", "''") + "'" for w in KEYWORDS)
    rules = [
        (rf"\x02(?:[A-Za-z](?:{s}[A-Za-z0-9_''])*(?:{s}\.(?:{s}[A-Za-z0-9_''])+)+|[A-Z](?:{s}[A-Za-z0-9_'']){{3,}})\x01", "@", False),
        (rf"\x02[a-z](?:{s}[a-z0-9''])*(?:{s}_(?:{s}[a-z0-9''])+)+\x01", "@", True),
        (rf"\x02[a-z](?:{s}[a-z0-9'']){{0,3}}\x01", "?", True),
        (r"\x02\p{Nd}+\x01", "#", False),
    ]
    out = sql_collapsed(e)
    for pattern, to, guard in rules:
        marked = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}_]+)', '\x01\x02\\1\x01\x02', 'g')"
        bare = "translate(x, '\x01\x02', '')"
        hit = f"regexp_full_match(x, '{pattern}')" + (f" and {bare} not in ({k})" if guard else "")
        out = f"translate(array_to_string(list_transform(regexp_extract_all({marked}, '(?s){pattern}|.'), lambda x: case when {hit} then '{to}' else x end), ''), '\x01\x02', '')"
    return out
