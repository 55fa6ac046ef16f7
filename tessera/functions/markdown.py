"""What a line of Markdown is, and what it says: a scanner over characters, after CommonMark.

Our own choices: emphasis of one word by underscores is a name (``__init__``)
and stays; strike-through goes; an autolink says its address; a backslash
before punctuation goes; delimiters without a partner stay.
"""

from __future__ import annotations

HEADING, ITEM, QUOTE, ROW, FENCE, TEXT = "heading", "item", "quote", "row", "fence", "text"
_BLANK = " \t"
#: characters that can open or close emphasis
_EMPHASIS = "*_~"


def _run(text: str, at: int) -> int:
    """How often the character at a place is repeated from there on."""
    end = at
    while end < len(text) and text[end] == text[at]:
        end += 1
    return end - at


def _ends(line: str, at: int) -> bool:
    return at >= len(line) or line[at] in _BLANK


def block(line: str) -> tuple[str, int]:
    """(kind, place at which the content begins) of one line."""
    at = len(line) - len(line.lstrip())
    if at == len(line):
        return TEXT, at
    first, run = line[at], _run(line, at)
    kind, begins = TEXT, at
    if first == "#" and run < 7 and at < 4 and _ends(line, at + run):
        kind, begins = HEADING, at + run
    elif first in "`~" and run > 2:
        kind, begins = FENCE, at + run
    elif first == ">":
        kind, begins = QUOTE, at + 1
    elif first == "|":
        kind = ROW
    elif first in "-+*" and run == 1 and _ends(line, at + 1):
        kind, begins = ITEM, at + 1
    elif "0" <= first <= "9":
        digits = at
        while digits < len(line) and "0" <= line[digits] <= "9":
            digits += 1
        if digits - at < 10 and line[digits : digits + 1] in (".", ")") and line[digits : digits + 1] and _ends(line, digits + 1):
            kind, begins = ITEM, digits + 1
    while begins < len(line) and line[begins] in _BLANK:
        begins += 1
    return kind, begins


def content(line: str) -> tuple[str, str]:
    """(kind of the innermost block, what it holds): quotes are looked into; a task's box and a heading's closing marks go."""
    kind, at = block(line)
    rest = line[at:].rstrip()
    while kind == QUOTE:
        kind, at = block(rest)
        rest = rest[at:]
    if kind == ITEM and len(rest) > 3 and rest[0] == "[" and rest[1] in " xX" and rest[2] == "]" and rest[3] in _BLANK:
        rest = rest[4:].lstrip()
    if kind == HEADING:
        bare = rest.rstrip("#")
        rest = bare.rstrip() if not bare or bare[-1] in _BLANK else rest
    return kind, rest


def _label(text: str, at: int) -> tuple[int, int] | None:
    """(end of the label, place after the target) of a link whose bracket opens at a place."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                break
        i += 1
    if i + 1 >= len(text) or text[i + 1] != "(":
        return None
    depth = 0
    for j in range(i + 1, len(text)):
        depth += (text[j] == "(") - (text[j] == ")")
        if not depth:
            return i, j + 1
    return None


def plain(text: str) -> str:
    """What a stretch of inline Markdown says: labels of links, code and emphasised words without their marks."""
    out: list[str] = []
    open_at: dict[str, list[int]] = {}  # by run of delimiters: where in ``out`` it stands

    def word_at(i: int) -> bool:
        return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")

    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1].isascii() and not text[i + 1].isalnum() and not text[i + 1].isspace():
            out.append(text[i + 1])
            i += 2
        elif c == "`":
            run = "`" * _run(text, i)
            start, end = i + len(run), i + len(run)
            while (end := text.find(run, end)) >= 0 and _run(text, end) != len(run):  # a longer run closes nothing
                end += _run(text, end)
            out.append(text[start:end].strip() if end >= 0 else run)
            i = end + len(run) if end >= 0 else start
        elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
            at = i + (c == "!")
            found = _label(text, at)
            out.append(plain(text[at + 1 : found[0]]) if found else text[i : at + 1])
            i = found[1] if found else at + 1
        elif c == "<" and (end := text.find(">", i)) > 0 and "://" in text[i:end] and " " not in text[i:end]:
            out.append(text[i + 1 : end])
            i = end + 1
        elif c in _EMPHASIS:
            run = c * _run(text, i)
            before, after = text[i - 1 : i], text[i + len(run) : i + len(run) + 1]
            closes = bool(before) and not before.isspace() and not (c == "_" and word_at(i + len(run)))
            opens = bool(after) and not after.isspace() and not (c == "_" and word_at(i - 1))
            stack = open_at.get(run, [])
            inside = "".join(out[stack[-1] + 1 :]) if stack and closes else ""
            if inside and (c != "_" or " " in inside):
                out[stack.pop()] = ""
            else:
                if opens and not (c == "~" and len(run) != 2):
                    open_at.setdefault(run, []).append(len(out))
                out.append(run)
            i += len(run)
        else:
            end = i + 1
            while end < len(text) and text[end] not in "\\`[!<*_~":
                end += 1
            out.append(text[i:end])
            i = end
    return "".join(out).strip()


def says_something(text: str) -> bool:
    """Whether there is a letter or a digit, and not mere decoration."""
    return any(map(str.isalnum, text))
