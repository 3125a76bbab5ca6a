"""Markup that holds code: JSX and Razor, read by a reader that switches between the two.

A file is cut into consecutive tokens of three kinds: ``tag`` and ``text`` of live markup, and ``dead`` for code, comments, scripts
and styles. In code, brackets are counted and literals and comments passed over, so a block ends at its own bracket however deep
others lie in it; markup inside code starts where a statement or an operand may start and ends with its element. Modes are kept
on a list, so depth costs no recursion, and every character is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TAG, TEXT, DEAD = "tag", "text", "dead"

# fixed values: elements without content (HTML Living Standard, void elements)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is a translation already: react-i18next's Trans and react-intl's FormattedMessage.
TRANSLATED = ("Trans", "FormattedMessage")
#: Razor's block statements and directives (ASP.NET Core documentation, Razor syntax reference).
STATEMENTS = frozenset("if for foreach while do switch using lock try".split())
BLOCKS = frozenset(("code", "functions"))
DIRECTIVES = frozenset((
    "addTagHelper attribute implements inherits inject layout model namespace page preservewhitespace removeTagHelper rendermode"
    " tagHelperPrefix typeparam").split())

RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)(?=[ \t\r\n\f/>]).*?(?:</\1[ \t\r\n]*>|\Z)")
FRAGMENTS = {"<>": "<Fragment>", "</>": "</Fragment>"}
NAME = re.compile(r"</?[ \t]*([A-Za-z_][\w:.-]*)?")
#: In code: literals and comments as a whole, then single characters that matter.
SCRIPT_CODE = re.compile(r"""(?s)[^"'`/{}()\[\]<;,]*+(?:(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<c>.))""")
SHARP_CODE = re.compile(r"""(?s)[^"'/{}()\[\]<;@]*+(?:(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|@\*.*?(?:\*@|\Z)|\$?@\$?"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<c>.))""")
IN_TAG = re.compile(r"""(?s)[^"'`{}<>/]*+(?P<c>.)""")
#: Before an element in script code: an operator, an opening bracket or a word that an expression follows.
OPERAND = re.compile(r"(?:^|[(\[{},;:?=&|!+*%^~]|=>|\b(?:return|default|case|do|else|typeof|void|yield|await|in|of))$")
REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
ELEMENT = re.compile(r"<(?:[A-Za-z_$][\w.$:-]*(?=[\s/>{])|>)")
GENERIC = re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
CHAINED = re.compile(r"[ \t\r\n]*(?:else(?:[ \t\r\n]+if\b)?|catch|finally|while)\b")
CHILDREN = re.compile(r"[^<{]*")
RAZOR_STOP = re.compile(r"(?s)[^<@]*+(?P<c>.)")
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")


def tag_end(text: str, at: int, razor: bool) -> int:
    """Behind the ``>`` of the tag at ``at``: values in quotes and expressions in brackets belong to it, whatever they hold."""
    i, n = at + 1, len(text)
    while i < n:
        m = IN_TAG.match(text, i)
        if not m:
            return n
        c, i = m["c"], m.end()
        if c == ">":
            return i
        if c in "\"'":
            i = _quoted(text, i, c) if razor else _close(text, i, c)
        elif c == "{" and not razor:
            i = code_end(text, i, "{", SCRIPT_CODE)
        elif c == "<":
            return i - 1  # the tag was never closed
    return n


def _close(text: str, at: int, quote: str) -> int:
    """Behind the closing quote; a value that is never closed ends where it starts."""
    end = text.find(quote, at)
    return at if end < 0 else end + 1


def _quoted(text: str, at: int, quote: str) -> int:
    """Behind the closing quote of a Razor value; quotes within ``@(…)`` are part of it."""
    i = at
    while True:
        end = text.find(quote, i)
        if end < 0:
            return at
        code = text.find("@(", i, end)
        if code < 0:
            return end + 1
        i = code_end(text, code + 2, "(", SHARP_CODE)


def code_end(text: str, at: int, opened: str, code: re.Pattern) -> int:
    """Behind the bracket that closes ``opened``, which was opened just before ``at``."""
    depth, i = 1, at
    closing = {"(": ")", "{": "}", "[": "]"}[opened]
    while True:
        m = code.match(text, i)
        if not m:
            return len(text)
        i, c = m.end(), m["c"]
        if c == opened:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return i
        elif c == "`":
            i = template_end(text, i)


def template_end(text: str, at: int) -> int:
    """Behind a template literal that was opened just before ``at``, with what its ``${…}`` hold."""
    levels, i = [0], at  # brackets open in each literal's current expression; 0: in its text
    stop = re.compile(r"(?s)[^`\\$]*+(?:\\.|(?P<c>\$\{|.))")
    while levels:
        if levels[-1] == 0:
            m = stop.match(text, i)
            if not m:
                return len(text)
            i = m.end()
            if m["c"] == "`":
                levels.pop()
            elif m["c"] == "${":
                levels[-1] = 1
        else:
            m = SCRIPT_CODE.match(text, i)
            if not m:
                return len(text)
            i, c = m.end(), m["c"]
            if c == "{":
                levels[-1] += 1
            elif c == "}":
                levels[-1] -= 1
            elif c == "`":
                levels.append(0)
    return i


class Tokens:
    """Consecutive tokens (kind, start, end); neighbours of one kind that are no tags become one."""

    def __init__(self):
        self.out: list[tuple[str, int, int]] = []
        self.at = 0

    def to(self, end: int, kind: str) -> None:
        if end <= self.at:
            return
        if self.out and kind != TAG and self.out[-1][0] == kind:
            self.out[-1] = (kind, self.out[-1][1], end)
        else:
            self.out.append((kind, self.at, end))
        self.at = end


def is_open(tag: str) -> bool:
    return not tag.startswith(("</", "<!", "<?")) and not tag.endswith("/>")


def jsx(text: str) -> list[tuple[str, int, int]]:
    """Tokens of a script file with elements."""
    t, n, i = Tokens(), len(text), 0
    modes: list[list] = [["code", 0]]  # code: open brackets; markup: open elements, and whether they are translated
    while i < n:
        mode = modes[-1]
        if mode[0] == "code":
            m = SCRIPT_CODE.match(text, i)
            if not m:
                break
            c, j = m["c"], m.end()
            if c is None:
                i = j
            elif c == "`":
                i = template_end(text, j)
            elif c == "/":
                r = REGEX.match(text, j - 1)
                i = r.end() if r and OPERAND.search(text[max(0, j - 40):j - 1].rstrip()) else j
            elif c in "([{":
                mode[1] += 1
                i = j
            elif c in ")]}":
                mode[1] -= 1
                i = j
                if mode[1] < 0 and len(modes) > 1 and c == "}":
                    modes.pop()
                    t.to(i, DEAD)
                mode[1] = max(0, mode[1])
            elif c == "<" and ELEMENT.match(text, j - 1) and not GENERIC.match(text, j - 1) and (
                    OPERAND.search(text[max(0, j - 40):j - 1].rstrip()) or (t.out and t.out[-1][0] == TAG and not text[t.at:j - 1].strip())):
                # an operand, or right behind the element before
                t.to(j - 1, DEAD)
                modes.append(["markup", 0])
                i = j - 1
            else:
                i = j
            continue
        # markup
        c = text[i]
        if c == "<":
            end = i + 2 if text.startswith("<>", i) else i + 3 if text.startswith("</>", i) else tag_end(text, i, False)
            tag = text[i:end]
            name = NAME.match(tag)[1]
            if is_open(tag) and name in TRANSLATED:
                end = _element_end(text, end, name)
                t.to(end, DEAD)
                if not mode[1]:
                    modes.pop()
                i = end
                continue
            t.to(end, TAG)
            i = end
            mode[1] += 1 if is_open(tag) else -1 if tag.startswith("</") else 0
            if mode[1] <= 0:
                modes.pop()
        elif c == "{":
            modes.append(["code", 0])
            i += 1
        else:
            i = CHILDREN.match(text, i).end()
            t.to(i, TEXT)
    t.to(n, DEAD if modes[-1][0] == "code" else TEXT)
    return t.out


def _element_end(text: str, at: int, name: str) -> int:
    """Behind the closing tag of an element opened before ``at``; elements of its name may lie in it."""
    depth, i = 1, at
    both = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])")
    while depth:
        m = both.search(text, i)
        if not m:
            return len(text)
        i = tag_end(text, m.start(), False)
        depth += -1 if m[1] else 1 if text[i - 2:i] != "/>" else 0
    return i


def razor(text: str) -> list[tuple[str, int, int]]:
    """Tokens of a Razor file. Inline expressions stay in their text, which no one translates as it stands."""
    t, n, i = Tokens(), len(text), 0
    modes: list[list] = [["markup", None]]  # markup: open elements, None for the file itself; code: open brackets
    fresh = True  # a statement may start here
    while i < n:
        mode = modes[-1]
        if mode[0] == "code":
            m = SHARP_CODE.match(text, i)
            if not m:
                i = n
                break
            c, j = m["c"], m.end()
            if text[i:j - len(c or "") if c else j].strip() and c is not None:
                fresh = False
            if c is None:
                if m["skip"][0] in "\"'$@" and not m["skip"].startswith("@*"):
                    fresh = False
                i = j
            elif c == "{":
                mode[1], fresh, i = mode[1] + 1, True, j
            elif c == "}":
                mode[1], fresh, i = mode[1] - 1, True, j
                if not mode[1]:
                    more = CHAINED.match(text, i)
                    head = more and _head_end(text, more.end())
                    if head and head > 0:
                        mode[1], i = 1, head
                    else:
                        modes.pop()
                        t.to(i, DEAD)
            elif c == ";":
                fresh, i = True, j
            elif c == "<" and (fresh or text[j - 2:j - 1] == "@") and re.match(r"[A-Za-z!]", text[j:j + 1]):
                t.to(j - 1, DEAD)
                modes.append(["markup", 0])
                i = j - 1
            elif c == "@" and fresh and text.startswith(":", j):
                t.to(j + 1, DEAD)
                end = text.find("\n", j)
                i = n if end < 0 else end
                t.to(i, TEXT)
            else:
                fresh = c == ")"  # behind the head of a statement without brackets of its own
                i = j
            continue
        m = RAZOR_STOP.match(text, i)
        if not m or m["c"] not in "<@":
            i = n
            t.to(n, TEXT)
            break
        at = m.end() - 1
        if m["c"] == "<":
            t.to(at, TEXT)
            raw = RAW.match(text, at)
            if raw:
                i = raw.end()
                t.to(i, DEAD)
                continue
            if not re.match(r"[A-Za-z/!?]", text[at + 1:at + 2]):
                i = at + 1
                continue
            i = tag_end(text, at, True)
            tag = text[at:i]
            name = (NAME.match(tag)[1] or "").lower()
            t.to(i, TAG)
            if mode[1] is not None:
                mode[1] += 1 if is_open(tag) and name not in VOID else -1 if tag.startswith("</") else 0
                if mode[1] <= 0:
                    modes.pop()
                    fresh = True
            continue
        # @
        if text.startswith("@@", at) or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            i = at + (2 if text.startswith("@@", at) else 1)
        elif text.startswith("@*", at):
            t.to(at, TEXT)
            end = text.find("*@", at)
            i = n if end < 0 else end + 2
            t.to(i, DEAD)
        elif text.startswith("@(", at):
            i = code_end(text, at + 2, "(", SHARP_CODE)
        elif text.startswith("@{", at):
            t.to(at, TEXT)
            i = code_end(text, at + 2, "{", SHARP_CODE)
            t.to(i, DEAD)
        else:
            word = IDENTIFIER.match(text, at + 1)
            name = word[0] if word else ""
            head = _head_end(text, word.end()) if name in STATEMENTS else 0
            brace = re.compile(r"[ \t\r\n]*\{").match(text, word.end()) if name in BLOCKS else None
            if name in ("using", *DIRECTIVES) and not (name == "using" and head):
                t.to(at, TEXT)
                end = text.find("\n", at)
                i = n if end < 0 else end
                t.to(i, DEAD)
            elif head:
                t.to(at, TEXT)
                modes.append(["code", 1])
                i, fresh = head, True
            elif brace:
                t.to(at, TEXT)
                i = code_end(text, brace.end(), "{", SHARP_CODE)
                t.to(i, DEAD)
            elif name == "section":
                t.to(at, TEXT)
                m = re.compile(r"section[ \t]+\w+[ \t\r\n]*\{").match(text, at + 1)
                i = m.end() if m else word.end()
                t.to(i, DEAD)
            else:
                i = _expression_end(text, word.end()) if word else at + 1
    t.to(n, DEAD if modes[-1][0] == "code" else TEXT)
    return t.out


def _head_end(text: str, at: int) -> int:
    """Behind the ``{`` of a statement whose keyword ends at ``at``, past its ``(…)``; 0 if there is none."""
    m = re.compile(r"[ \t\r\n]*").match(text, at)
    at = m.end()
    if text.startswith("(", at):
        at = code_end(text, at + 1, "(", SHARP_CODE)
        at = re.compile(r"[ \t\r\n]*").match(text, at).end()
    return at + 1 if text.startswith("{", at) else 0


def _expression_end(text: str, at: int) -> int:
    """Behind an inline expression: members, calls and indexes that follow each other without blanks."""
    while True:
        if text.startswith(("(", "["), at):
            at = code_end(text, at + 1, text[at], SHARP_CODE)
        else:
            m = re.compile(r"[?!]?\.[A-Za-z_]\w*").match(text, at)
            if not m:
                return at
            at = m.end()


READERS = {"jsx": jsx, "razor": razor}


def live(text: str, dialect: str, window: int) -> Iterator[dict]:
    """Tags and texts that are not blank, with their neighbours (a dead one as the start of a comment, a fragment by a name)."""
    tokens = READERS[dialect](text)
    line = line_at = 0

    def seen(k: int) -> str:
        if not 0 <= k < len(tokens):
            return ""
        kind, a, b = tokens[k]
        return "<!--" if kind == DEAD else FRAGMENTS.get(text[a:b], text[a:b])

    for k, (kind, a, b) in enumerate(tokens):
        if kind == DEAD or (kind == TEXT and text[a:b].isspace()):
            continue
        line += text.count("\n", line_at, a)
        line_at = a
        yield {"before": seen(k - 1), "token": text[a:b], "after": seen(k + 1), "span_start": a, "line": line + 1,
               "around": text[a:b] if kind == TAG else text[max(0, a - window):b + window]}
