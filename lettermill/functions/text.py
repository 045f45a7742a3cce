"""Scalar text functions, as Column expressions; Python (vectorized) where brackets and quotes have to be matched."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions import patterns as P


def _last(chars: str) -> str:
    """The last run of characters (the inside of a class), found at its beginning alone: a search would begin anew at each of them."""
    return f"(?<![{chars}])[{chars}]++"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s++|" + _last(r"\s") + r"\z", "")


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one behind the last break; none of an empty text."""
    parts = F.split(text, P.LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@functools.cache
def fold_tables() -> tuple[str, str]:
    """Characters that compatibility decomposition turns into one base character (and marks), and those."""
    pairs = []
    for code in range(128, 0xFFFF):
        if not 0xD800 <= code < 0xE000:
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(code):
                pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without marks; đ, which doesn't decompose, stays."""
    src, dst = fold_tables()
    return F.regexp_replace(F.lower(F.translate(F.lower(text), src, dst)), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Distinct words of folded letters and digits."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)))


def folded_name(text: Column) -> Column:
    """Folded with đ as d and single spaces, for look-ups by name."""
    return strip(F.regexp_replace(F.translate(fold(text), "đ", "d"), r"(?U)\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fix_misread(text: Column) -> Column:
    return F.translate(text, *P.OCR_MISREAD)


def real_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def _without_notes(text: Column, note: str, also: str) -> Column:
    """Drops clusters of note lines with the blank lines at them; a sentence that a cluster broke is joined again."""
    cluster = rf"(?:[ \t]*\n)?{note}[^\n]*(?:\n(?:{note}[^\n]*|[ \t]*(?=\n|\z)))*+"
    flags = "(?iU)"
    joined = F.regexp_replace(text, rf"{flags}([^\s.!?;:])[ \t]*\n{cluster}\n[ \t]*(?=(?-i:[(_\"' ]*[\p{{Ll}}\p{{IsLowercase}}]{also}))", "$1 ")
    return F.regexp_replace(F.regexp_replace(joined, rf"{flags}(?<=\n|\A){cluster}(?:\n|\z)", ""), _last(r"\n") + r"\z", "")


def clean_footer(text: Column) -> Column:
    """Without footnotes marked by superscript numbers, and without references to them."""
    return F.regexp_replace(_without_notes(text, r"[ \t]*\*{0,2}" + P.FOOTNOTE_MARK, r"|\("), P.SUPERSCRIPT, "")


def remove_footnotes(text: Column) -> Column:
    """Without footnotes in block quotes."""
    return _without_notes(text, r"[ \t]*>", "")


#: White space within a line.
INNER = r"[\s&&[^\n]]"


def clean_text(text: Column) -> Column:
    """Lines without markdown at their ends, breaks and superscripts; runs of blank lines as one."""
    trim = rf"(?Umd)^{INNER}++|{_last(INNER)}$"
    x = F.regexp_replace(F.regexp_replace(text, P.LINE_BREAK, "\n"), trim, "")
    x = F.regexp_replace(x, r"(?md)^(?:#+[ \t]*|\*\*|\*|_+|>[ \t]*)", "")
    x = F.regexp_replace(x, r"(?md)^[ *_#>]++|" + _last(" *_#>") + "$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"<br>|<br/>|</br>", " "), r"<sup>[^<\n]*</sup>", "")
    x = F.regexp_replace(F.regexp_replace(x, rf"(?U){INNER}+", " "), trim, "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\n++|" + _last(r"\n") + r"\z", "")


def clean_petition(text: Column) -> Column:
    """Without quotes and underscores around, and with one mark at the end: of the quotes and marks there the first mark stays."""
    out = F.regexp_replace(strip(text), "(?U)^[\\s“”\"'‘’_]+", "")
    quotes, marks = "\\s”\"'‘’_", ".!?;:"
    out = F.regexp_replace(out, rf"(?U)(?<![{quotes}{marks}])(\s*+)[{quotes}]*+([{marks}])[{quotes}{marks}]*+\z", "$1$2")
    return strip(F.regexp_replace(out, rf"(?U){_last(quotes)}\z", ""))


def clean_answer(text: Column, cleaner=clean_text) -> Column:
    return cleaner(remove_footnotes(text))


def normalize_markdown(text: Column) -> Column:
    """Without orphaned stars behind item numbers and heading marks within lines."""
    out = F.regexp_replace(text, r"(?U)((?:\(\w++\)|(?<!\d)\d++[.)])\s*+)\*{1,2}\s+", "$1 ")
    return F.regexp_replace(F.regexp_replace(out, r"(?mU)(?<=\S)\s+#{1,6}\s+", " "), r"[ \t]{2,}", " ")


def strip_markdown(text: Column) -> Column:
    """Plain text of CommonMark without lists: emphasis, links, headings, quotes and code marks go; a hard break stays, a soft one is a space."""

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        from lettermill.functions.markdown import plain_text

        return x.map(plain_text, na_action="ignore")

    return plain(normalize_markdown(text))


def clean_line(x: Column) -> Column:
    """Of each line, without a list mark, heading marks and a number in front."""
    blank = r"[ \t\x0B\f\r]"
    x = F.regexp_replace(x, rf"(?md)^{blank}*[-*•◦▪▸]{blank}+", "")
    x = F.regexp_replace(F.regexp_replace(x, rf"(?md)^#{{1,6}}{blank}*", ""), rf"(?md)^\d{{1,3}}{blank}*[.．)\]]{blank}+", "")
    return F.regexp_replace(x, rf"(?Umd)^{INNER}++|{_last(INNER)}$", "")


def clean_block(text: Column) -> Column:
    """Cleaned lines, paragraphs apart by one blank line, without quotes and emphasis."""
    out = F.regexp_replace(F.regexp_replace(clean_line(text), "\n{2,}", "\n\n"), r"^\n+", "")
    return strip(F.regexp_replace(F.translate(out, "”“\"'‘’*_", ""), r"[ \t]+", " "))


def trim_list_mark(text: Column) -> Column:
    return F.regexp_replace(text, _last(",;") + r"\z", "")


def delegation(line: Column) -> Column:
    """The delegation that a line names, with its capitalised province; the bare phrase without one."""
    out = F.lit(P.DELEGATION)
    for marker in reversed(P.DELEGATION_OF):
        behind = F.regexp_extract(line, rf"(?iUs){marker}(.*)", 1)
        words = F.transform(F.filter(F.split(behind, r"(?U)\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[;,:.]++|" + _last(";,:.") + r"\z", ""))
        stop = F.array_position(F.transform(words, lambda w: w.rlike(r"^\p{IsUppercase}")), False)  # from 1, 0 if there is none
        names = F.when(stop == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
        out = F.when(F.lower(line).contains(marker.lower()), F.concat_ws(" ", F.lit(marker), F.array_join(names, " "))).otherwise(out)
    return strip(out)


def letter_number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, P.LETTER_NUMBER, 1), r"(?U)[*\s]", ""), F.lit(""))


def issue_date(text: Column) -> Column:
    """DD/MM/YYYY of the first date of issue; null if its month is missing."""
    d, m, y = (F.regexp_extract(text, P.ISSUE_DATE, i) for i in (1, 2, 3))
    return F.when((d != "") & (m != ""), F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y))


def signer(text: Column) -> Column:
    """The minister who signs in the last lines; the bare title without an acceptable name; null without a title."""
    last = lines(text)
    tail = F.array_join(F.slice(last, F.greatest(F.lit(1), F.size(last) - P.TAIL_LINES + 1), P.TAIL_LINES), "\n")
    most = P.SIGNER_CHARS + 40  # a name with more white space inside is too long anyway
    tail = F.regexp_replace(tail, rf"(?U){INNER}{{{most},}}+", " " * most)
    names = F.transform(F.regexp_extract_all(tail, F.lit(P.SIGNER), F.lit(1)), strip)
    good = F.filter(names, lambda x: (x != "") & (F.length(x) <= P.SIGNER_CHARS) & ~x.rlike(P.LEGAL_WORDS))
    return F.when(F.size(names) > 0, F.concat_ws(" ", F.lit(P.MINISTER), F.try_element_at(good, F.lit(1))))


def metadata(text: Column) -> Column:
    return F.struct(letter_number(text).alias("so_cong_van"), issue_date(text).alias("ngay_ban_hanh"), signer(text).alias("nguoi_ky"))


def is_header(line: Column) -> Column:
    x = strip(line)
    return x.startswith("#") | x.startswith("**") | x.startswith("Kính gửi") | x.startswith("Số:") | x.startswith("-")


def is_petition_heading(line: Column) -> Column:
    x, low = strip(line), F.lower(line)
    return low.contains(P.S1_PHRASE) & ~low.rlike(P.S1_NOT) & (x.startswith("#") | x.startswith("**") | x.startswith("_"))


def is_stop(line: Column) -> Column:
    """Lines that end an answer, apart from headings."""
    return line.rlike(P.GROUP) | line.rlike(P.LETTER_END) | line.rlike(P.CLOSING) | line.rlike(P.RESPONSIBILITY)


def has_structure(text: Column) -> Column:
    return text.contains("**") | text.rlike(r"(?m)^[ \t\x0B\f]*+#")


def is_footnote(line: Column) -> Column:
    return F.ltrim(line).startswith(">")


def strip_fence(text: Column) -> Column:
    """What stands in a code fence, else the text."""
    inner = strip(F.regexp_extract(text, r"(?s)^\s*+```[a-zA-Z]*+(.*?)```", 1))
    return F.when(inner != "", inner).otherwise(strip(text))


def after_thinking(text: Column) -> Column:
    return strip(F.substring_index(text, " response", -1))


def clean_json_text(text: Column) -> Column:
    """JSON text without a byte order mark and a code fence, and with plain quotes for smart ones outside strings."""
    token = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[“”‘’]', re.DOTALL)
    plain = {"“": '"', "”": '"', "‘": "'", "’": "'"}

    @F.pandas_udf("string")
    def quoted(x: pd.Series) -> pd.Series:
        return x.map(lambda s: token.sub(lambda m: plain.get(m.group(), m.group()), s.replace("\ufeff", "")), na_action="ignore")

    return strip_fence(quoted(text))


def outer_json(text: Column) -> Column:
    """The first array or object of a text, up to its bracket's end (brackets in strings don't count); null without one."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)

    def first(s: str) -> str | None:
        begin = re.search(r"[\[{]", s)
        depth, close = 0, "]" if begin and begin.group() == "[" else "}"
        for m in token.finditer(s, begin.start()) if begin else ():
            depth += (m.group() == begin.group()) - (m.group() == close)
            if not depth:
                return s[begin.start() : m.end()]
        return None

    @F.pandas_udf("string")
    def outer(x: pd.Series) -> pd.Series:
        return x.map(first, na_action="ignore")

    return outer(text)
