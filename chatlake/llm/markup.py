"""Problem 2: clean text from HTML, Markdown, wiki and LaTeX markup.

Method: layout-aware rendering. Code blocks and formulas are set aside first; LaTeX, wiki and
Markdown constructs become the elements they stand for (headings, lists, tables, quotes, links,
emphasis), written as tags of our own beside those of HTML, and one tree builder with implied tags
and visibility rules takes both. The tree is rendered without recursion: block spacing, headings,
nested and numbered lists, code blocks, formulas and aligned table cells stay, everything else
becomes its visible text. Each construct that is consumed names its notation, so the same pass says
which markup a text held.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element names of HTML.
ELEMENTS = set(
    """a abbr acronym address area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col
    colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5
    h6 head header hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol
    optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary
    sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
)
#: Names that are also words for placeholders: they need an attribute or an end tag to be markup.
WORDS = set("address area article base body button caption code data details dialog dir figure font footer form frame head header input label legend link main map mark menu meta meter nav object option output param picture progress section select source summary table template text time title track var video".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = set("script style head title template noscript noframes iframe object svg datalist textarea select audio video canvas map".split())
#: Opening the key ends an open element of the values, up to the nearest scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Python names that are no emphasis.
_DUNDERS = r"(?:init|main|name|file|all|dict|class|call|repr|str|len|iter|next|enter|exit|new|del|doc|eq|hash|getattr|setattr|version)"

_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_TAG = re.compile(rf"<(/?)({_NAMES})((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?)>", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CODE = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^`\n]*)(?:\n(?P<body>[\s\S]*?))?(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><pre(?:\s[^<>]*)?>(?P<prebody>[\s\S]*?)(?:</pre\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(?P<verbbody>[\s\S]*?)(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<wiki><(?P<wtag>syntaxhighlight|source|nowiki)(?:\s[^<>]*)?>(?P<wbody>[\s\S]*?)(?:</(?P=wtag)>|\Z))"
    r"|(?P<hidden><(?P<htag>script|style)(?:\s[^<>]*)?>[\s\S]*?(?:</(?P=htag)\s*>|\Z))"
    r"|(?P<comment><!--[\s\S]*?(?:-->|\Z))",
    re.M | re.I,
)
_INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
#: What begins a formula; ``$..$`` is matched whole, with guards against prices, and spans lines only where it holds a sign of a formula.
_FORMULA = re.compile(
    r"\\begin\{(?P<env>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}"
    r"|(?P<slashes>\\+)(?P<bracket>[\[(])"
    r"|(?P<display>\$\$)(?!\$)"
    r"|(?<![\\$\w])\$(?![\s$])(?=[^$\n]*[\\^_={}+*/<>|!()-]|[A-Za-z]\$)(?!\d[\d.,]*[\s-])[^$\n]+(?<![\s\\$])\$(?![\w$])"
    r"|(?<![\\$\w])\$(?![\s$])(?=[^$]*[\\^_={}])(?!\d[\d.,]*[\s-])[^$\n]+(?:\n(?![ \t]*\n)[^$\n]*)+(?<![\s\\$])\$(?![\w$])"
)
_BRACKETS = {"[": (re.compile(r"(\\+)([\[\]])"), "]"), "(": (re.compile(r"(\\+)([()])"), ")")}
#: Words between two signs such as price ranges ``$$`` and no sign of a formula.
_PROSE = re.compile(r"\s[^\\^_={}+*/<>|0-9]*[^\W\d_]{2}[^\\^_={}+*/<>|0-9]*")
_MATH_TAG = re.compile(r"<math>([\s\S]*?)</math>", re.I)

# LaTeX, beyond code and formulas.
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_DROPPED = re.compile(r"[~ ]?\\(?:label|cite[a-z]*|ref|eqref|pageref|autoref|cref|index|vspace|hspace|documentclass|usepackage|input|include|bibliography|bibliographystyle)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}(?:\{[^{}\n]*\})?")
_UNWRAPPED = re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}(?:\{([^{}]*)\})?")
_LIST_ENV = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?")
_ANY_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_ITEM = re.compile(r"\\item(?![A-Za-z])(?:\[([^\]\n]*)\])?[ \t]*")
_BARE = re.compile(r"(?<![\w:\\])\\(?:LaTeX|TeX|maketitle|newpage|newline|noindent|centering|hline|par|ldots|dots|quad|qquad|bigskip|medskip|smallskip|tableofcontents)(?![A-Za-z\\])")

# Wiki text.
_WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n?([\s\S]*?)(?:^\|\}|\Z)", re.M)
_TEMPLATE = re.compile(r"\{\{(?!\s*[\w.]*[_.][\w.]*\s*\}\})(?!\s\w+\s\}\})([^{}\n|]+)((?:\|[^{}]*)?)\}\}")
_WIKI_LINK = re.compile(r"\[\[(?![\s\d.,\-\"']*\]|[\s\-!\"'$\d])([^\[\]\n|]+)((?:\|[^\[\]\n]*)*)\]\]")
_EXTERNAL = re.compile(r"\[((?:https?|ftp)://[^\s\[\]]+)(?:[ \t]+([^\[\]\n]*))?\](?!\()")
_WIKI_EMPHASIS = re.compile(r"(?<![\w'])('{2,3}|'{5})(?=[^\s'])((?:[^'\n]|'(?!'))+?)(?<=\S)\1(?!')")
_DEFINITION = re.compile(r"^;[ \t]*(\S[^\n]*)\n((?::[ \t]*[^\n]*(?:\n|\Z))+)", re.M)
_WIKI_TAG = re.compile(r"</?(?:ref|references|gallery)(?:\s[^<>]*)?/?>|__(?:TOC|NOTOC|FORCETOC)__", re.I)

# Markdown.
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?![ \t]*(?:[-*+>|#=]|\d+[.)]))[ ]{0,3}(\S[^\n]*)\n[ ]{0,3}(=+|-{3,})[ \t]*$", re.M)
_RULE = re.compile(r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_MD_TABLE = re.compile(r"^([^\n]*\|[^\n]*)\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$((?:\n[^\n]*\|[^\n]*)*)", re.M)
_QUOTE = re.compile(r"^[ ]{0,3}(?:>[ ]?)+(?=\s|\S)", re.M)
_TASK = re.compile(r"^([ \t]*)[-*+][ \t]+\[([ xX])\][ \t]+", re.M)
_BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+(?=\S)", re.M)
_NUMBERED = re.compile(r"^([ \t]*)(\d{1,9})[.)][ \t]+(?=\S)", re.M)
_IMAGE_OR_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s]*)?)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_REFERENCE_LINK = re.compile(r"(?<![\w\]])!?\[(?![\d\s,.\-]*\])([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_REFERENCE = re.compile(r"^[ ]{0,3}\[(?!\^)([^\[\]\n]+)\]:[ \t]*(\S+)[^\n]*$", re.M)
_FOOTNOTE_TEXT = re.compile(r"^[ ]{0,3}\[\^([^\]\s]+)\]:[ \t]*", re.M)
_FOOTNOTE = re.compile(r"\[\^([^\]\s]+)\]")
_BOLD = re.compile(rf"(?<![\w*])\*\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*(?![*\w])|(?<![\w_])__(?!{_DUNDERS}__)(?=[^\s_])((?:[^_\n]|_(?!_))+?)(?<=[^\s_])__(?![\w_])")
_STRUCK = re.compile(r"(?<![\w~])~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?![\w~])")
_EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_AUTOLINK = re.compile(r"<((?:https?|ftp)://[^\s<>]+)>")

#: Characters or line starts without which a text holds no markup; the others never reach Python.
#: Wider than any pattern above: stand-in characters count, as they are taken out first, and digits of all scripts.
ANY_MARK = r"(?m)[<&\\$`*_~#=\[{|\uE000\uE001]|''|^[ \t]*(?:[>;]|-[ \t]*-|(?:[-+]|\p{Nd}+[.)])[ \t])|-{3}"

#: Tags of our own: what other notations than HTML become.
_OWN_TAG = re.compile("\ue002(/?)([a-z0-9]+)([^\ue002\ue003]*)\ue003")
_ANY_TAG = re.compile(_OWN_TAG.pattern + "|" + _TAG.pattern, re.I)


#: Attribute of elements that stand on lines of their own in the text: they bring no blank lines.
LINES = " lines"


def tag(name: str, inner: str, attrs: str = "") -> str:
    """``inner`` inside an element of our own."""
    return f"\ue002{name}{attrs}\ue003{inner}\ue002/{name}\ue003"


def begin(name: str, attrs: str = "") -> str:
    return f"\ue002{name}{attrs}\ue003"


def end(name: str) -> str:
    return f"\ue002/{name}\ue003"


def table_of(rows: list[list[str]]) -> str:
    """Rows of cells as a table element."""
    return tag("table", "".join(tag("tr", "".join(tag("td", c) for c in r)) for r in rows if r), LINES)


_KEEP = "\ue000{}\ue001"
_KEPT = re.compile("\ue000(\\d+)\ue001")


class Kept:
    """Pieces set aside, each under a stand-in that the converters pass over."""

    def __init__(self):
        self.pieces: list[tuple[str, bool]] = []

    def keep(self, text: str, block: bool = False) -> str:
        self.pieces.append((text, block))
        return _KEEP.format(len(self.pieces) - 1)

    def restore(self, text: str) -> str:
        # A piece only holds pieces set aside before it.
        while _KEPT.search(text):
            text = _KEPT.sub(lambda m: self.pieces[int(m[1])][0], text)
        return text


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []


def build_tree(text: str, real) -> Node:
    """Tree of the tags of ``text`` that ``real`` accepts, with implied end tags; other characters are text."""
    root = Node("root")
    stack = [root]
    held: Counter = Counter()  # open elements by name
    at = 0

    def close(i: int) -> None:
        held.subtract(n.name for n in stack[i:])
        del stack[i:]

    for m in _ANY_TAG.finditer(text):
        own = m[2] is not None
        if not own and not real(m[4], m[5], m[6]):
            continue
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        ends_it, name, attrs = (m[1], m[2], m[3]) if own else (m[4], m[5].lower(), m[6])
        if ends_it:
            if held[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            elif name == "p":
                stack[-1].children.append(Node("p"))
            continue
        ends, scope = IMPLIED.get(name, (set(), set()))
        if name in BLOCKS and held["p"]:
            # A block ends an open paragraph, unless a cell or item stands between.
            k = max(i for i, n in enumerate(stack) if n.name == "p")
            if not any(n.name in ("td", "th", "li", "dd") for n in stack[k:]):
                close(k)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in scope:
                    break
                if stack[i].name in ends:
                    close(i)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID and not attrs.endswith("/"):
            stack.append(node)
            held[name] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


_INVISIBLE = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _aligned(rows: list[list[str]]) -> str:
    """Table rows with cells padded to the width of their column."""
    width = max((len(r) for r in rows), default=0)
    sizes = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(width)]
    return "\n".join(" | ".join(c.ljust(s) for c, s in zip(r + [""] * (width - len(r)), sizes)).rstrip() for r in rows if any(c for c in r))


def _block(text: str) -> str:
    text = text.strip("\n")
    return f"\n\n{text}\n\n" if text.strip() else ""


class Rows(list):
    """Rows of a table with the texts that stand among them."""

    def __init__(self, rows=(), others=()):
        super().__init__(rows)
        self.others = list(others)

    def text(self) -> str:
        return "\n".join(x for x in (*self.others, _aligned(self)) if x)


_VALUE = re.compile(r"value=(\d+)")


def render_tree(root: Node) -> str:
    """Visible text of a tree, from the leaves up, at any depth."""
    work: list[tuple[Node, list, int]] = [(root, [], 0)]
    while True:
        node, done, at = work.pop()
        children = node.children
        while at < len(children) and isinstance(children[at], str):
            done.append((None, children[at]))
            at += 1
        if at < len(children):
            work.append((node, done, at + 1))
            work.append((children[at], [], 0) if _shown(children[at]) else (Node("root"), [], 0))
            continue
        got = _rendered(node, done)
        if not work:
            return got
        work[-1][1].append((node, got))


def _shown(node: Node) -> bool:
    return node.name not in HIDDEN and not (node.attrs and _INVISIBLE.search(node.attrs))


def _plain(got) -> str:
    return _block(got.text()) if isinstance(got, Rows) else got


def _rendered(node: Node, done: list[tuple[Node | None, str]]) -> str:
    """Text of one node, given those of its children; rows of tables stay apart until their table."""
    name = node.name
    block = str if node.attrs == LINES else _block
    if name == "br":
        return "\n"
    if name == "hr":
        return "---" if node.attrs == LINES else "\n\n---\n\n"
    if name == "img":
        m = _ALT.search(node.attrs)
        return (m[1] or m[2] or m[3] or "") if m else ""
    if name == "tr":
        return Rows([[" ".join(_plain(g).split()) for c, g in done if c is not None]])
    if name in ("table", "thead", "tbody", "tfoot"):
        rows = Rows()
        for c, got in done:
            if isinstance(got, Rows):
                rows += got
                rows.others += got.others
            elif c is not None and c.name in ("td", "th"):  # a cell without a row
                rows.append([" ".join(got.split())])
            elif got.strip():
                rows.others.append(got.strip())
        return block(rows.text()) if name == "table" else rows
    if name in ("ul", "ol", "menu", "dir"):
        items, number = [], 0
        for c, got in done:
            got = _plain(got)
            if c is not None and c.name == "li":
                value = _VALUE.search(c.attrs) if c.attrs else None
                number = int(value[1]) if value else number + 1
                mark = f"{number}. " if name == "ol" else "- "
                body = re.sub(r"\n{2,}", "\n", got.strip())
                items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            elif got.strip():
                items.append(got.strip())
        return block("\n".join(items))
    inner = "".join(_plain(got) for _, got in done)
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        title = " ".join(inner.split())
        return block("#" * int(name[1]) + " " + title) if title else ""
    if name == "blockquote":
        return block("\n".join("> " + x for x in inner.strip().split("\n")))
    if name == "dd":
        return "\n  " + inner.strip().replace("\n", "\n  ")
    if name == "dt":
        return "\n" + inner.strip()
    if name in ("td", "th"):
        return inner + "\t"
    if name == "sup" and inner.strip():
        return "^" + inner.strip()
    if name == "sub" and inner.strip():
        return "_" + inner.strip()
    return _block(inner) if name in BLOCKS else inner


def _pipes(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _formula_end(text: str, m: re.Match, lacking: set[str]) -> int:
    """Where the formula that ``m`` begins ends, -1 if it is none; ``lacking`` holds the ends that do not occur any more."""
    begin = m.end()
    if m["display"]:
        end = text.find("$$", begin)
        body = text[begin : max(end, begin)]
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        own_line = not line.strip() and body.lstrip(" \t").startswith("\n")
        return end + 2 if body.strip() and (own_line or not _PROSE.fullmatch(body)) else -1
    if m["bracket"] and len(m["slashes"]) % 2:
        sign, last = _BRACKETS[m["bracket"]]
        for s in sign.finditer(text, begin):
            if s[2] == last:
                return s.end() if s.start() > begin or len(s[1]) > 1 else -1
            if len(s[1]) % 2:  # begins again: the first was never closed
                return -1
        return -1
    if not m["bracket"] and not m["env"]:
        return begin
    # The backslashes of the text are doubled, or this is a line break of LaTeX.
    last = "\\\\" + _BRACKETS[m["bracket"]][1] if m["bracket"] else f"\\end{{{m['env']}}}"
    end = -1 if last in lacking else text.find(last, begin)
    if end < 0:
        lacking.add(last)
    return end + len(last) if end > begin or m["env"] and end == begin else -1


_TABULAR = re.compile(r"\\begin\{(?P<env>tabular[xy*]?|longtable|array|tabbing)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*(?P<rows>(?:(?!\\begin\{)[\s\S])*?)\\end\{(?P=env)\}")
_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^{}]*\})")
_BRACE = re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|[{}]")


def unwrapped(text: str) -> str:
    """Commands of LaTeX replaced by their argument (of two, the second), from the innermost out, in one pass; braces of other use stay, and what stands around them."""
    out: list[str] = []
    stack: list[list] = []  # slot of the opening in ``out``, its text, whether the command must stay, whether this is its second argument
    at = 0
    for m in _BRACE.finditer(text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] != "}":
            out.append(m[0])
            stack.append([len(out) - 1, m[0] == "{", False])
            continue
        if not stack:
            out.append("}")
            continue
        slot, stays, second = stack.pop()
        if stays:
            out.append("}")
            if stack:
                stack[-1][1] = True
            continue
        if not second and text.startswith("{", at):
            close = _BRACE.search(text, at + 1)
            if close and close[0] == "}":
                # A second argument without braces takes the place of the first.
                del out[slot:]
                out.append(text[at + 1 : close.start()])
                at = close.end()
                continue
        out[slot] = ""
    return "".join(out) + text[at:]


class Rendering:
    """One text on its way to clean text; ``found`` collects the notations met."""

    def __init__(self):
        self.found: set[str] = set()
        self.kept = Kept()

    def run(self, text: str) -> str:
        # Stand-in characters of the text itself would be mistaken for ours.
        text = re.sub("[\ue000-\ue003]", "", text).replace("\r\n", "\n")
        text = _CODE.sub(self.code, text)
        text = _INLINE_CODE.sub(lambda m: self.hit("markdown", self.kept.keep(m[2].strip())), text)
        text = _MATH_TAG.sub(lambda m: self.hit("wiki", self.kept.keep(f"${m[1].strip()}$")), text)
        text = self.formulas(text)
        text = self.latex(text)
        text = self.wiki(text)
        text = self.markdown(text)
        text = self.html(text)
        text = self.kept.restore(text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+(?=\n|\Z)", "", text)).strip("\n")

    def hit(self, notation: str, text: str) -> str:
        self.found.add(notation)
        return text

    def code(self, m: re.Match) -> str:
        if m["fence"] is not None:
            body = m["body"] or ""
            return self.hit("markdown", self.kept.keep(f"```{m['info'].strip()}\n{body.strip(chr(10))}\n```", True))
        if m["pre"] is not None:
            body = html.unescape(re.sub(r"<[^<>]*>", "", m["prebody"])).strip("\n")
            return self.hit("html", "\n" + self.kept.keep(f"```\n{body}\n```", True) + "\n")
        if m["verb"] is not None:
            body = m["verbbody"].strip("\n")
            return self.hit("latex", self.kept.keep(f"```\n{body}\n```", True))
        if m["wiki"] is not None:
            if m["wtag"].lower() == "nowiki":
                return self.hit("wiki", self.kept.keep(m["wbody"]))
            body = m["wbody"].strip("\n")
            return self.hit("wiki", self.kept.keep(f"```\n{body}\n```", True))
        return self.hit("html", "")  # scripts, styles and comments show nothing

    def formulas(self, text: str) -> str:
        """Formulas in LaTeX delimiters set aside, whatever their length, in one pass over ``text``."""
        out, at, start = [], 0, 0
        lacking: set[str] = set()
        while m := _FORMULA.search(text, start):
            end = _formula_end(text, m, lacking)
            if end < 0:
                start = m.end()
                continue
            out += [text[at : m.start()], self.hit("latex", self.kept.keep(text[m.start() : end]))]
            at = start = end
        return "".join(out) + text[at:]

    def latex(self, text: str) -> str:
        if "\\" not in text:
            return text
        before = text
        levels = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
        text = _SECTION.sub(lambda m: "\n\n" + tag(f"h{levels[m[1]]}", m[2].strip()) + "\n\n", text)
        text = _DROPPED.sub("", text)
        if "\\item" in text or _LIST_ENV.search(text):
            text = self.latex_lists(text)
        if "&" in text:
            text = _TABULAR.sub(lambda m: table_of([[_RULES.sub("", c).strip() for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\(?:\[[^\]\n]*\])?", m["rows"]) if _RULES.sub("", r).strip()]), text)
        text = _ANY_ENV.sub("", text)
        text = unwrapped(text)
        text = _BARE.sub("", text)
        if text != before:
            self.found.add("latex")
            text = re.sub(r"\\([%&#_{}$])", r"\1", text)
        return text

    def latex_lists(self, text: str) -> str:
        """Lists as elements; the tree builder ends an item where the next one or the list's end comes."""
        kinds = {"itemize": "ul", "enumerate": "ol", "description": "ul"}
        open_lists = 0
        out = []
        for line in text.split("\n"):
            m = _LIST_ENV.search(line)
            if m:
                open_lists += 1 if m[1] == "begin" else -1
                line = _LIST_ENV.sub(lambda m: begin(kinds[m[2]]) if m[1] == "begin" else end(kinds[m[2]]), line)
            if "\\item" in line:
                stray = open_lists <= 0
                line = _ITEM.sub(lambda i: (begin("ul") if stray else "") + begin("li") + (f"{i[1]}: " if i[1] else ""), line.lstrip()) + (end("ul") if stray else "")
            out.append(line)
        return "\n".join(out)

    def wiki(self, text: str) -> str:
        before = text
        if "=" in text:
            text = _WIKI_HEADING.sub(lambda m: tag(f"h{len(m[1])}", m[2].strip(), LINES) if len(m[1]) > 1 else m[0], text)
        if "{" in text:
            text = _WIKI_TABLE.sub(self.wiki_table, text)
            # Templates inside templates: from the innermost out, at any depth.
            while (new := _TEMPLATE.sub(self.template, text)) != text:
                text = new
        if "[" in text:
            text = _WIKI_LINK.sub(self.wiki_link, text)
            text = _EXTERNAL.sub(lambda m: tag("a", (m[2] or m[1]).strip()), text)
        if "''" in text:
            text = _WIKI_EMPHASIS.sub(lambda m: tag("em", m[2]), text)
        text = _WIKI_TAG.sub("", text)
        text = _DEFINITION.sub(lambda m: tag("dl", tag("dt", m[1]) + "".join(tag("dd", x[1:].strip()) for x in m[2].split("\n") if x)) + "\n", text)
        if text != before:
            self.found.add("wiki")
        return text

    def wiki_table(self, m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in m[1].split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line.startswith("|+"):
                rows.insert(0, [line[2:].strip()])
            elif line.startswith(("|", "!")):
                for cell in re.split(r"\|\||!!", line[1:]):
                    rows[-1].append(re.sub(r"^[^\[\]|{}]*=[^\[\]|{}]*\|(?!\|)", "", cell).strip())
            elif line and rows[-1]:
                rows[-1][-1] += " " + line
        return table_of(rows) + "\n"

    def template(self, m: re.Match) -> str:
        name = m[1].strip().lower()
        values = [v.strip() for v in m[2].split("|")[1:]]
        if name.startswith(("infobox", "taxobox")):
            return "\n".join(f"{k.strip()}: {v.strip()}" for k, _, v in (x.partition("=") for x in values) if v.strip())
        if name in ("quote", "blockquote", "lang", "nowrap", "em", "strong", "code", "cquote"):
            return values[-1] if values else ""
        return ""

    def wiki_link(self, m: re.Match) -> str:
        target, labels = m[1].strip(), [x.strip() for x in m[2].split("|")[1:]]
        space = target.partition(":")[0].lower()
        if space == "category":
            return ""
        if space in ("file", "image"):
            return labels[-1] if labels and labels[-1] not in ("thumb", "frame", "left", "right", "center") else ""
        return tag("a", labels[-1] if labels and labels[-1] else target.replace("#", ": "))

    def markdown(self, text: str) -> str:
        before = text
        if "|" in text:
            text = _MD_TABLE.sub(lambda m: table_of([_pipes(x) for x in (m[1] + m[2]).split("\n") if x.strip()]) if not m[1].lstrip().startswith("{|") else m[0], text)
        if "[" in text:
            text = _FOOTNOTE_TEXT.sub(r"(\1) ", text)
            text = _FOOTNOTE.sub(r"(\1)", text)
            text = _REFERENCE.sub("", text)
            text = _IMAGE_OR_LINK.sub(lambda m: tag("a", m[2] or ("" if m[1] else m[3])), text)
            text = _REFERENCE_LINK.sub(lambda m: tag("a", m[1]), text)
        if "#" in text:
            text = _ATX.sub(lambda m: tag(f"h{len(m[1])}", m[2], LINES), text)
        text = _SETEXT.sub(lambda m: tag("h1" if m[2][0] == "=" else "h2", m[1], LINES), text)
        text = _RULE.sub(lambda m: begin("hr", LINES), text)
        if ">" in text:
            text = self.quotes(text)
            text = _AUTOLINK.sub(lambda m: tag("a", m[1]), text)
        text = self.lists(text)
        text = _BOLD.sub(lambda m: tag("strong", m[1] or m[2]), text)
        text = _STRUCK.sub(lambda m: tag("s", m[1]), text)
        text = _EMPHASIS.sub(lambda m: tag("em", m[1] or m[2]), text)
        if text != before:
            self.found.add("markdown")
            text = re.sub(r"\\([\\`*_{}\[\]()#+.!|>~-])", r"\1", text)
        return text

    def quotes(self, text: str) -> str:
        """Lines after ``>`` as one quotation each run."""
        out, quoted = [], []
        for line in [*text.split("\n"), None]:
            m = _QUOTE.match(line) if line else None
            if m:
                quoted.append(line[m.end() :])
                continue
            if quoted:
                out.append(tag("blockquote", "\n".join(quoted), LINES))
                quoted = []
            if line is not None:
                out.append(line)
        return "\n".join(out)

    def lists(self, text: str) -> str:
        """Bulleted, numbered and task lines as nested lists by their indentation; single numbered lines are none."""
        numbered = len(_NUMBERED.findall(text)) > 1
        if not numbered and not _BULLET.search(text) and not _TASK.search(text):
            return text
        out: list[str] = []
        stack: list[tuple[int, str]] = []  # indentation and element of the open lists
        last = -1  # the last line of a list

        def close(indent: int, kind: str = "") -> None:
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and kind and stack[-1][1] != kind):
                out[last] += end(stack.pop()[1])

        for line in text.split("\n"):
            task = _TASK.match(line)
            m = task or _BULLET.match(line) or (_NUMBERED.match(line) if numbered else None)
            if m:
                indent, kind = len(m[1].expandtabs(4)), "ol" if not task and m.lastindex == 2 else "ul"
                close(indent, kind)
                mark = begin("li", f" value={m[2]}" if kind == "ol" else "") + (f"[{m[2].lower()}] " if task else "")
                if not stack or stack[-1][0] < indent:
                    stack.append((indent, kind))
                    mark = begin(kind, LINES) + mark
                out.append(mark + line[m.end() :])
                last = len(out) - 1
            elif stack and line.strip() and (len(line) - len(line.lstrip()) <= stack[0][0] or not line[0].isspace()):
                close(-1)
                out.append(line)
            elif stack and line.strip():
                out.append(line.strip())  # goes on with the item
                last = len(out) - 1
            else:
                out.append(line)
        if stack:
            close(-1)
        return "\n".join(out)

    def html(self, text: str) -> str:
        found_own = "\ue002" in text
        real = lambda ends, name, attrs: False
        if "<" in text:
            closed = {m[2].lower() for m in _TAG.finditer(text) if m[1]}

            def real(ends: str, name: str, attrs: str) -> bool:
                name = name.lower()
                return name not in WORDS or bool(attrs.strip(" /")) or name in closed

            if any(real(*m.groups()) for m in _TAG.finditer(text)):
                self.found.add("html")
                found_own = True
        if found_own:
            text = render_tree(build_tree(text, real))
        if "<" in text:
            text = re.sub(r"<!DOCTYPE[^>]*>", lambda m: self.hit("html", ""), text, flags=re.I)
        if "&" in text:

            def entity(m: re.Match) -> str:
                if m[0][1] != "#" and m[0][1:] not in html5:
                    return m[0]
                return self.hit("html", html.unescape(m[0]))

            text = _ENTITY.sub(entity, text)
        return text


def render(text: str) -> tuple[str, list[str]]:
    """Clean text, and the notations that ``text`` held, in order of name."""
    r = Rendering()
    out = r.run(text)
    return (out if r.found else text), sorted(r.found)


def rendered_parts(mapping: DataFrame) -> DataFrame:
    """(node_id, part_no, text, markup): each part that may hold markup, rendered; ``markup`` lists the notations it held.

    Null parts and elements give no rows; parts without a character of markup are left out and stand as they are; nodes of
    content_type code are left out, their text being code as a whole. Repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for t in batch.column(2).to_pylist():
                text, notations = render(t)
                texts.append(text)
                found.append(notations)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["node_id", "part_no", "text", "markup"])

    rows = mapping.where("parts IS NOT NULL AND (content_type IS NULL OR content_type <> 'code')").select("node_id", F.posexplode("parts").alias("part_no", "part"))
    rows = rows.where(F.col("part").rlike(ANY_MARK))
    return rows.mapInArrow(run, "node_id string, part_no int, text string, markup array<string>")


def clean_parts(mapping: DataFrame) -> DataFrame:
    """(node_id, part_no, text, markup) of every string of parts: rendered where it holds markup, otherwise as it is."""
    plain = mapping.where("parts IS NOT NULL").select("node_id", "content_type", F.posexplode("parts").alias("part_no", "text")).where("text IS NOT NULL")
    untouched = plain.where(~F.col("text").rlike(ANY_MARK) | F.coalesce(F.col("content_type") == "code", F.lit(False)))
    return rendered_parts(mapping).unionByName(untouched.select("node_id", "part_no", "text", F.array().cast("array<string>").alias("markup")))


def markup_found(mapping: DataFrame) -> DataFrame:
    """(node_id, markup), distinct: the notations that occur in each node's parts."""
    return rendered_parts(mapping).select("node_id", F.explode("markup").alias("markup")).distinct()
