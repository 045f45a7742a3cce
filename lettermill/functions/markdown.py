"""Plain text of one CommonMark text, lists left as they are: a helper of text.strip_markdown().

Blocks are found line by line; emphasis is settled with a stack of delimiter runs.
"""

from __future__ import annotations

import html
import re
import unicodedata

HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
QUOTE = re.compile(r" {0,3}> ?")
MARKUP = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z][^>]*)>", re.DOTALL)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")
MARKUP_BLOCK = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$))", re.IGNORECASE)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
SPACE = re.compile(r"\s*")
ANGLED = re.compile(r"<(?:[^<>\n\\]|\\.)*>")
TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.DOTALL)
BLANKS = re.compile(" *")
SAME = {c: re.compile(re.escape(c) + "+") for c in "`*_"}
#: Brackets within brackets in a link's target, and quotes within quotes: deeper ones are one.
DEEPEST = 32
QUOTES = re.compile(r"(?: {0,3}> ?)*")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _target(s: str, at: int) -> int:
    """The end of a link's target (from its bracket on), 0 if there is none."""
    i = SPACE.match(s, at + 1).end()
    if m := ANGLED.match(s, i):
        i = m.end()
    else:
        depth = 0
        while i < len(s) and not s[i].isspace() and (s[i] != ")" or depth):
            depth += (s[i] == "(") - (s[i] == ")")
            if depth > DEEPEST:
                return 0
            i += 1 + (s[i] == "\\")
    end = SPACE.match(s, i).end()
    if end > i and (m := TITLE.match(s, end)):
        end = SPACE.match(s, m.end()).end()
    return end + 1 if s[end : end + 1] == ")" else 0


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def inline(s: str) -> str:
    """Plain text of a paragraph's content."""
    out: list[str] = []
    runs: list[list] = []  # place in out, mark, length, can open, can close, length at first
    opened: list[tuple[int, bool, int]] = []  # place in out of an opening bracket, whether it is an image's, runs before it
    unclosed: set[int] = set()  # lengths of runs of backticks that no later one closes
    i = 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s) and (s[i + 1] in MARKS or s[i + 1] == "\n"):
            out.append(s[i + 1])
            i += 2
            if s[i - 1] == "\n":
                i = BLANKS.match(s, i).end()
            continue
        if c == "`":
            n = SAME["`"].match(s, i).end() - i
            end = None if n in unclosed else re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, i + n)
            if not end:
                unclosed.add(n)
            code = s[i + n : end.start()].replace("\n", " ") if end else s[i : i + n]
            out.append(code[1:-1] if end and code[:1] == code[-1:] == " " and code.strip() else code)
            i = end.end() if end else i + n
            continue
        if c == "<" and (m := AUTOLINK.match(s, i) or MARKUP.match(s, i)):
            out.append(m.group(1) if m.re is AUTOLINK else "")
            i = m.end()
            continue
        if c == "&" and (m := ENTITY.match(s, i)):
            out.append(html.unescape(m.group()))
            i = m.end()
            continue
        if c == "\n":
            hard = out[-2:] == [" ", " "]
            while out and out[-1] == " ":
                out.pop()
            out.append("\n" if hard else " ")
            i = BLANKS.match(s, i + 1).end()
            continue
        if c in "*_":
            n = SAME[c].match(s, i).end() - i
            before, after = s[i - 1] if i else " ", s[i + n] if i + n < len(s) else " "
            left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
            right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
            opens = left and (c == "*" or not right or _punctuation(before))
            closes = right and (c == "*" or not left or _punctuation(after))
            runs.append([len(out), c, n, opens, closes, n])
            out.append(c * n)
            i += n
            continue
        if c == "[" or s.startswith("![", i):
            opened.append((len(out), c == "!", len(runs)))
            out.append("![" if c == "!" else "[")
            i += len(out[-1])
            continue
        if c == "]" and opened:
            place, image, first = opened.pop()
            end = _target(s, i + 1) if s[i + 1 : i + 2] == "(" else 0
            if end:
                out[place] = ""
                _settle(runs, out, first)
                if not image:
                    opened = [x for x in opened if x[1]]  # no links in links
                i = end
                continue
        out.append(c)
        i += 1
    _settle(runs, out, 0)
    return "".join(out)


def _settle(runs: list[list], out: list[str], first: int) -> None:
    """Takes the delimiters of emphasis out, from the first run on."""
    live: list[list] = []  # runs that can still open
    searched: dict[tuple, int] = {}  # of each kind of closing run, below which place of live no opener is
    for close in runs[first:]:
        while close[4] and close[2]:
            kind = (close[1], close[3], close[5] % 3)
            for j in range(len(live) - 1, searched.get(kind, 0) - 1, -1):
                opener = live[j]
                odd = (opener[4] or close[3]) and (opener[5] + close[5]) % 3 == 0 and (opener[5] % 3 or close[5] % 3)
                if opener[1] == close[1] and not odd:
                    break
            else:
                searched[kind] = len(live)
                break
            n = 2 if opener[2] >= 2 and close[2] >= 2 else 1
            for run in (opener, close):
                run[2] -= n
                out[run[0]] = run[1] * run[2]
            del live[j + (opener[2] > 0) :]  # what is between opens nothing any more
            searched = {k: min(v, len(live)) for k, v in searched.items()}
        if close[3] and close[2]:
            live.append(close)
    del runs[first:]


def blocks(lines: list[str], depth: int = 0) -> list[str]:
    """The plain text of each block, with the break behind it."""
    out: list[str] = []
    paragraph: list[str] = []

    def close(mark: str = "\n\n") -> None:
        if paragraph:
            out.append(inline("\n".join(x.lstrip(" \t") for x in paragraph).rstrip(" \t")) + mark)
            paragraph.clear()

    i = 0
    while i < len(lines):
        x = lines[i]
        if not x.strip():
            close()
        elif QUOTE.match(x):
            close()
            inner = []
            while i < len(lines) and (QUOTE.match(lines[i]) or (lines[i].strip() and inner and inner[-1].strip() and not (RULE.match(lines[i]) or FENCE.match(lines[i]) or HEADING.match(lines[i])))):
                inner.append((QUOTE if depth < DEEPEST else QUOTES).sub("", lines[i], count=1))
                i += 1
            out += blocks(inner, depth + 1)
            continue
        elif m := FENCE.match(x):
            close()
            body, mark = [], m.group(2)
            i += 1
            while i < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", lines[i]):
                body.append(re.sub(rf"^ {{0,{len(m.group(1))}}}", "", lines[i]))
                i += 1
            out.append("\n".join(body).rstrip("\n") + "\n")
        elif m := HEADING.match(x):
            close()
            out.append(inline((m.group(1) or "").strip()) + "\n\n")
        elif paragraph and UNDERLINE.match(x):
            close()
        elif RULE.match(x):
            close()
        elif not paragraph and x.startswith(("    ", "\t")):
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(re.sub(r"^(?: {1,4}|\t)", "", lines[i]))
                i += 1
            out.append("\n".join(body).rstrip("\n") + "\n")
            continue
        elif MARKUP_BLOCK.match(x):
            close()
            comment = "-->" if "<!--" in x[:7] else None
            while i < len(lines) and (comment not in lines[i] if comment else lines[i].strip()):
                i += 1
        else:
            paragraph.append(x)
        i += 1
    close()
    return out


def plain_text(text: str) -> str:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(blocks(lines))).strip()
