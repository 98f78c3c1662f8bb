"""Facts of one Markdown text: headings, fences, definitions, links, code spans, own-voice words.

Blocks are found line by line: container marks (quotes, list items) are peeled off each
line, what is left makes leaf blocks. The inline text of a leaf is its lines without their
marks, with the offset of every character in the source, so all facts carry offsets.
No extension of CommonMark is read. This module does not know Spark.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

ID = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")
#: The keywords of normative prose; a modal may be followed by NOT.
MODALS = ("MUST", "SHALL", "SHOULD")
KEYWORDS = ("REQUIRED", "RECOMMENDED", "MAY", "OPTIONAL")
#: How many bytes may lie between a bold id and the colon that makes it a definition.
ASIDE_BYTES = 128

QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+(?=\S)|(?=[ \t]*\Z))")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)\Z", re.DOTALL)
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
#: Names of tags that begin an HTML block; those of VERBATIM end with a closing tag, not at a blank line.
VERBATIM = "script|pre|style|textarea"
BLOCK_TAGS = """address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|
h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul""".replace("\n", "")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)*[^\s\[\]\\](?:[^\[\]\\]|\\.)*)\]:[ \t]*(?:\n[ \t]*)?(?:<([^<>\n]*)>|([^\s<]\S*))(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)", re.DOTALL)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->", re.DOTALL)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
DESTINATION = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
#: (begin, end) of HTML blocks; end None: a blank line. The last kind does not interrupt a paragraph.
HTML_BLOCKS = tuple(
    (re.compile(" {0,3}" + begin, re.I), end and re.compile(end, re.I))
    for begin, end in (
        (rf"<(?:{VERBATIM})(?=[ \t>]|\Z)", rf"</(?:{VERBATIM})>"),
        ("<!--", "-->"),
        (r"<\?", r"\?>"),
        (r"<!\[CDATA\[", r"\]\]>"),
        ("<![A-Z]", ">"),
        (rf"</?(?:{BLOCK_TAGS})(?=[ \t>]|/>|\Z)", None),
        (rf"(?!<!--)(?:{TAG.pattern})[ \t]*\Z", None),
    )
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Leaf:
    kind: str  # heading, fence, code, html, paragraph
    start: int
    end: int
    quoted: bool
    text: str = ""  # inline text, or a fence's content
    at: list[int] = field(default_factory=list)  # source offset of each character of text
    level: int = 0
    info: str = ""
    until: re.Pattern | None = None  # what ends an HTML block that blank lines do not end


@dataclass
class Facts:
    headings: list = field(default_factory=list)  # (start, end, level, text)
    fences: list = field(default_factory=list)  # (start, end, info, text)
    bolds: list = field(default_factory=list)  # (start, end, token)
    anchors: list = field(default_factory=list)  # (start, end, id)
    links: list = field(default_factory=list)  # (start, dest)
    codes: list = field(default_factory=list)  # (start, text, in_heading)
    words: list = field(default_factory=list)  # (start, keyword)
    line_starts: list = field(default_factory=list)

    def line(self, offset: int) -> int:
        return bisect_right(self.line_starts, offset)


def slug_of(text: str) -> str:
    return "".join("-" if c == " " else c for c in text.lower() if c in " -_" or c.isalnum() or unicodedata.category(c)[0] == "M")


def slugs(texts: list[str]) -> list[str]:
    """Slugs in order; one that is taken gets the next free number of its own count."""
    used, count, out = set(), {}, []
    for text in texts:
        base = name = slug_of(text)
        while name in used:
            count[base] = count.get(base, 0) + 1
            name = f"{base}-{count[base]}"
        used.add(name)
        out.append(name)
    return out


def columns(text: str, at: int = 0) -> int:
    """The columns of the blanks that text starts with, from column `at`; tab stops are four apart."""
    column = at
    for c in text:
        if c == " ":
            column += 1
        elif c == "\t":
            column += 4 - column % 4
        else:
            break
    return column - at


def blanks(text: str, width: int, at: int = 0) -> int:
    """How many of text's leading characters make `width` columns; a tab that reaches beyond counts as one."""
    n = 0
    while n < len(text) and text[n] in " \t" and columns(text[:n], at) < width:
        n += 1
    return n


def blocks(source: str) -> tuple[list[Leaf], dict[str, str]]:
    """The leaf blocks of a text in order, and its link definitions."""
    leaves: list[Leaf] = []
    definitions: dict[str, str] = {}
    open_: Leaf | None = None  # a paragraph, fence or html block that may go on
    fence: tuple[str, int, int] | None = None  # mark, indent, containers
    containers: list[int] = []  # -1 a quote, else the indent of a list item's content
    offset = 0

    def close() -> None:
        nonlocal open_, fence
        if open_ is not None and open_.kind == "paragraph":
            take_definitions(open_, definitions)
            if not open_.text.strip():
                leaves.remove(open_)
        open_ = fence = None

    for raw in source.splitlines(keepends=True) if "\r" not in source and not re.search("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", source) else re.findall(r"[^\n]*\n|[^\n]+", source):
        line, at, kept = raw.rstrip("\r\n"), 0, 0
        for c in containers:  # containers that this line goes on with
            rest = line[at:]
            if c == -1:
                m = QUOTE.match(rest)
                if not m:
                    break
                at += m.end()
            elif rest.strip() == "" or columns(rest) >= c:
                at += blanks(rest, c)
            else:
                break
            kept += 1
        whole = kept == len(containers)
        if fence is not None:
            if whole and kept == fence[2]:
                body = line[at:]
                m = FENCE.match(body)
                if m and m[2][0] == fence[0][0] and len(m[2]) >= len(fence[0]) and not m[3].strip():
                    open_.end = offset + len(raw)
                    close()
                else:
                    strip = min(fence[1], len(body) - len(body.lstrip(" ")))
                    open_.text += body[strip:] + "\n"
                    open_.end = offset + len(raw)
                offset += len(raw)
                continue
            close()
        if open_ is not None and open_.until is not None:
            if whole:
                open_.end = offset + len(raw)
                if open_.until.search(line[at:]):
                    close()
                offset += len(raw)
                continue
            close()
        lazy = not whole and open_ is not None and open_.kind == "paragraph"
        containers_before = list(containers)
        opened = False
        del containers[kept:]
        while True:  # new containers
            rest = line[at:]
            m = QUOTE.match(rest)
            if m:
                if open_ is not None:
                    close()
                containers.append(-1)
                at += m.end()
                opened = True
                continue
            m = ITEM.match(rest)
            if m and not RULE.match(rest) and (open_ is None or open_.kind != "paragraph" or lazy or rest[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1")):
                if open_ is not None:
                    close()
                mark = m.end(2)
                space = columns(m[3], mark)
                width = mark + (space if 0 < space <= 4 else 1)
                containers.append(width)
                at += min(mark + blanks(rest[mark:], width - mark, mark), len(rest))
                opened = True
                continue
            break
        body = line[at:]
        here = offset + at
        quoted = -1 in containers
        if not body.strip():
            close()
        elif lazy and not opened and not ATX.match(body) and not FENCE.match(body) and not RULE.match(body) and html_begun(body, True) is None:
            containers[:] = containers_before  # a paragraph goes on without its marks
            add_line(open_, body, here, offset + len(raw))
        elif open_ is not None and open_.kind == "html" and whole:
            open_.end = offset + len(raw)
        else:
            if not whole or opened:
                if open_ is not None:
                    close()
            m = FENCE.match(body)
            if open_ is not None and open_.kind == "paragraph" and SETEXT.match(body):
                open_.kind, open_.level, open_.end = "heading", 1 if "=" in body else 2, offset + len(raw)
                open_ = None
            elif RULE.match(body):
                close()
            elif ATX.match(body):
                close()
                m = ATX.match(body)
                leaf = Leaf("heading", here, offset + len(raw), quoted, level=len(m[1]))
                if m[2]:
                    leaf.text, leaf.at = m[2], [here + m.start(2) + i for i in range(len(m[2]))]
                leaves.append(leaf)
            elif m and not (m[2][0] == "`" and "`" in m[3]):
                close()
                open_ = Leaf("fence", here, offset + len(raw), quoted, info=m[3])
                leaves.append(open_)
                fence = m[2], len(m[1]), len(containers)
            elif (found := html_begun(body, open_ is not None and open_.kind == "paragraph")) is not None:
                close()
                open_ = Leaf("html", here, offset + len(raw), quoted, until=found[1])
                leaves.append(open_)
                if open_.until is not None and open_.until.search(body, found[0]):
                    close()
            elif open_ is not None and open_.kind == "paragraph":
                add_line(open_, body, here, offset + len(raw))
            elif body.startswith("    ") or body.startswith("\t"):
                leaves.append(Leaf("code", here, offset + len(raw), quoted, body, [here + i for i in range(len(body))]))
            else:
                open_ = Leaf("paragraph", here, offset + len(raw), quoted)
                leaves.append(open_)
                add_line(open_, body, here, offset + len(raw))
        offset += len(raw)
    close()
    return leaves, definitions


def html_begun(body: str, in_paragraph: bool) -> tuple[int, re.Pattern | None] | None:
    """(where its mark ends, what ends it) of the HTML block that a line begins, or None."""
    for begin, end in HTML_BLOCKS[:-1] if in_paragraph else HTML_BLOCKS:
        if m := begin.match(body):
            return m.end(), end
    return None


def add_line(leaf: Leaf, body: str, here: int, end: int) -> None:
    if leaf.text:
        leaf.text += "\n"
        leaf.at.append(leaf.end - 1)
    skip = len(body) - len(body.lstrip(" \t"))
    leaf.text += body[skip:]
    leaf.at += range(here + skip, here + len(body))
    leaf.end = end


def take_definitions(leaf: Leaf, definitions: dict[str, str]) -> None:
    while m := DEFINITION.match(leaf.text):
        definitions.setdefault(label(m[1]), unescaped(m[2] if m[2] is not None else m[3]))
        leaf.text, leaf.at = leaf.text[m.end() :], leaf.at[m.end() :]


def label(text: str) -> str:
    return " ".join(text.split()).casefold()


def entity(text: str) -> str:
    """What a character reference stands for; itself if it is none."""
    return html5.get(text[1:], text) if text[1] != "#" else unescape(text) if text not in ("&#0;", "&#x0;") else "\ufffd"


def unescaped(text: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])|" + ENTITY.pattern, lambda m: m[1] or entity(m[0]), text)


@dataclass
class Run:
    """A run of * or _ that may open or close emphasis; pieces are what it gave, innermost first."""

    event: int
    mark: str
    left: int
    opens: bool
    closes: bool
    size: int
    opened: list[int] = field(default_factory=list)
    closed: list[int] = field(default_factory=list)


def flanking(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether the run of text[start] may open, and close, emphasis."""
    kind = lambda c: 0 if not c or c.isspace() else 1 if c in PUNCTUATION or unicodedata.category(c)[0] in "PS" else 2
    before, after = kind(text[start - 1 : start]), kind(text[end : end + 1])
    left = after == 2 or after == 1 and before != 2
    right = before == 2 or before == 1 and after != 2
    if text[start] == "*":
        return left, right
    return left and (not right or before == 1), right and (not left or after == 1)


def paired(runs: list[Run]) -> None:
    """Each closing run takes marks from the nearest run before it that opens; runs between the two stay text."""
    done: list[Run] = []
    for run in runs:
        while run.closes and run.left:
            both = lambda o, run=run: (o.closes or run.opens) and (o.size + run.size) % 3 == 0 and (o.size % 3 or run.size % 3)
            k = next((k for k in range(len(done) - 1, -1, -1) if done[k].mark == run.mark and not both(done[k])), None)
            if k is None:
                break
            opener = done[k]
            n = 2 if min(opener.left, run.left) >= 2 else 1
            opener.opened.append(n)
            run.closed.append(n)
            opener.left -= n
            run.left -= n
            del done[k + (opener.left > 0) :]
        if run.opens and run.left:
            done.append(run)


def settled(events: list[list], runs: list[Run]) -> list[list]:
    """events with each run as its marks, and what is left of it as text."""
    of, out = {r.event: r for r in runs}, []
    for k, e in enumerate(events):
        if k not in of:
            out.append(e)
            continue
        r, at = of[k], e[1]
        for kind, n in [*[("mark", n) for n in r.closed], ("text", r.left), *[("mark", n) for n in reversed(r.opened)]]:
            if n:
                out.append([kind, at, at + n, r.mark * n])
                at += n
    return out


def inlines(text: str, definitions: dict[str, str]):
    """Events (kind, start, end, value) of inline text: text, code, link, end, html, strong, break."""
    events: list[list] = []
    brackets: list[tuple[int, int, bool, int]] = []  # (event index, position, image, runs before it)
    runs: list[Run] = []  # those that may still be paired
    every: list[Run] = []
    i, n, plain = 0, len(text), 0

    def flush(to: int) -> None:
        if to > plain:
            events.append(["text", plain, to, text[plain:to]])

    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in PUNCTUATION:
            flush(i)
            events.append(["text", i, i + 2, text[i + 1]])
            i += 2
            plain = i
        elif c == "`":
            m = re.compile("`+").match(text, i)
            close = re.compile(f"(?<!`){m[0]}(?!`)").search(text, m.end())
            if not close:
                i = m.end()
                continue
            flush(i)
            value = text[m.end() : close.start()].replace("\n", " ")
            if len(value) > 2 and value[0] == value[-1] == " " and value.strip():
                value = value[1:-1]
            events.append(["code", i, close.end(), value])
            i = plain = close.end()
        elif c == "<" and (m := AUTOLINK.match(text, i)):
            flush(i)
            events.append(["link", i, m.end(), m[1] if ":" in m[1] else "mailto:" + m[1]])
            events.append(["text", i + 1, m.end() - 1, m[1]])
            events.append(["end", m.end(), m.end(), ""])
            i = plain = m.end()
        elif c == "<" and (m := TAG.match(text, i)):
            flush(i)
            events.append(["html", i, m.end(), m[0]])
            i = plain = m.end()
        elif c == "\n":
            flush(i)
            events.append(["break", i, i + 1, "\n"])
            i = plain = i + 1
        elif c in "*_":
            flush(i)
            m = re.compile(re.escape(c) + "+").match(text, i)
            runs.append(Run(len(events), c, m.end() - i, *flanking(text, i, m.end()), m.end() - i))
            every.append(runs[-1])
            events.append(["mark", i, m.end(), m[0]])
            i = plain = m.end()
        elif c == "&" and (m := ENTITY.match(text, i)) and entity(m[0]) != m[0]:
            flush(i)
            events.append(["text", i, m.end(), entity(m[0])])
            i = plain = m.end()
        elif c == "[" or c == "!" and text.startswith("![", i):
            flush(i)
            width = 1 if c == "[" else 2
            events.append(["text", i, i + width, text[i : i + width]])
            brackets.append((len(events) - 1, i, width == 2, len(runs)))
            i = plain = i + width
        elif c == "]":
            flush(i)
            plain = i
            if brackets:
                k, start, image, below = brackets.pop()
                m, dest, stop = DESTINATION.match(text, i + 1), None, i + 1
                if m:
                    dest, stop = unescaped(m[1] if m[1] is not None else m[2]), m.end()
                else:
                    r = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, i + 1)
                    name = r[1] if r and r[1].strip() else text[start + 1 + image : i]
                    dest = definitions.get(label(name))
                    stop = r.end() if r and dest is not None else i + 1
                if dest is not None:
                    events[k] = ["image" if image else "link", start, stop, dest]
                    events.append(["end", i, stop, ""])
                    paired(runs[below:])
                    del runs[below:]
                    if not image:
                        brackets.clear()  # no link inside a link
                    i = plain = stop
                    continue
            i += 1
        else:
            i += 1
    flush(n)
    paired(runs)
    return settled(events, every)


def keywords_in(text: str):
    """(position, keyword) of the normative words of one stretch of text; a modal takes a following NOT."""
    found = [(m.start(), m[0]) for m in re.finditer("[A-Za-z]+", text)]
    i = 0
    while i < len(found):
        at, word = found[i]
        if word in MODALS:
            if i + 1 < len(found) and found[i + 1][1] == "NOT":
                yield at, word + " NOT"
                i += 1
            else:
                yield at, word
        elif word in KEYWORDS:
            yield at, word
        i += 1


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"\s{name}\s*=\s*(\"([^\"]*)\"|'([^']*)')", tag)
    return None if not m else m[2] if m[2] is not None else m[3]


def token_of(text: str, whole: bool) -> str | None:
    """The word in brackets that text starts with, or (whole) consists of."""
    m = re.match(r"\[([^\[\]\n]*)\]", text.strip() if whole else text)
    if not m or whole and m.end() != len(text.strip()):
        return None
    return m[1]


def has_colon(text: str, at: int) -> bool:
    """Whether a colon follows a bold id in plain text of its line, inline wrappers hopped, within the budget."""
    start, i = at, at
    while i < len(text) and len(text[start:i].encode()) < ASIDE_BYTES:
        c = text[i]
        if c == ":":
            return True
        if c in "\n`":
            return False
        if c in "*_":
            m = re.compile(re.escape(c) + "+").match(text, i)
            close = text.find(m[0], m.end())
            if close < 0:
                i = m.end()
            else:
                i = close + len(m[0])
        elif c == "[" and (m := re.compile(r"\[[^\[\]]*\]").match(text, i)):
            d = DESTINATION.match(text, m.end())
            i = d.end() if d else m.end()
        else:
            i += 1
    return False


def facts(source: str) -> Facts:
    leaves, definitions = blocks(source)
    out = Facts(line_starts=[0] + [m.end() for m in re.finditer("\n", source)])
    for leaf in leaves:
        if leaf.kind == "fence":
            out.fences.append((leaf.start, leaf.end, leaf.info.strip(), leaf.text))
            continue
        if leaf.kind == "html":
            continue
        if leaf.kind == "code":  # indented code speaks, but holds no markup
            if not leaf.quoted:
                out.words += [(leaf.at[p], w) for p, w in keywords_in(leaf.text)]
            continue
        events = inlines(leaf.text, definitions)
        place = lambda p, leaf=leaf: leaf.at[p] if p < len(leaf.at) else leaf.end
        heading = leaf.kind == "heading"
        if heading:
            text = "".join(" " if k == "break" else v for k, _, _, v in events if k in ("text", "code", "break")).strip()
            out.headings.append((leaf.start, leaf.end, leaf.level, text))
        stretch, where = "", []
        for e in [*events, ["stop", 0, 0, ""]]:
            if e[0] == "text":
                stretch += e[3]
                where += [min(e[1] + j, e[2] - 1) for j in range(len(e[3]))]
            else:
                if not leaf.quoted:
                    out.words += [(place(where[p]), w) for p, w in keywords_in(stretch)]
                stretch, where = "", []
        for j, (kind, start, end, value) in enumerate(events):
            if kind == "link":
                out.links.append((place(start), value))
            elif kind == "code":
                out.codes.append((place(start), value, heading))
            elif kind == "html":
                opened = re.match(r"<a(?=\s)", value, re.I)
                follows = events[j + 1] if j + 1 < len(events) else None
                if opened and follows and follows[0] == "html" and follows[1] == end and re.match(r"</a\s*>", follows[3], re.I):
                    name = attribute(value, "id")
                    if name is not None:
                        out.anchors.append((place(start), place(follows[2] - 1) + 1, name))
            elif kind == "mark" and value == "**" and not heading:
                at = place(start)
                if at == 0 or source[at - 1] == "\n":
                    close = next((x for x in events[j + 1 :] if x[0] == "mark" and x[3] == "**"), None)
                    if close:
                        inner = leaf.text[end : close[1]]
                        token = token_of(inner, True)
                        coded = any(x[0] != "text" for x in events if end <= x[1] < close[1])
                        if token is not None and not coded and has_colon(leaf.text, close[2]):
                            out.bolds.append((at, place(close[2] - 1) + 1, token))
    return out
