"""Secret scans: pattern spans plus assignment-aware lexing.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The
lexer then reads a text as source or configuration code: it finds pairs of a
name and a literal (``name = "x"``, ``name: x``, ``"name": "x"``,
``name => 'x'``, ``export NAME=x``, ``name="x"`` in tags), joins literals that
are concatenated with ``+`` or stand side by side, follows names assigned to
other names, and scores each literal by how sensitive the names are that it
reaches and by how random it looks. Literals that score ``threshold`` or more,
and those whose start a base span takes, become spans of kind ``literal``
unless one base span covers them whole; base spans stay as they are.

Pairs that stand in other forms are read by a pattern each (``FORMS``): texts
in triple quotes, block scalars, macro definitions, command-line options,
elements of a tag, comparisons, arguments of setters and of calls whose result
a name receives, several names assigned at once. A password in a URL and a PEM
private key count without a name.

All work is per row: no shuffle, one text at a time. Only texts that hold a
sensitive name next to an assignment sign are lexed.

Edge cases: null text scans as empty; very long texts are scanned whole;
repeated rows give repeated results; an empty table gives no rows; extra columns
pass through, and give way to a new column of their name; offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import annotate, set_aside

KINDS = ("assign", "access", "hex", "literal")
_FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be left out here

#: Parts of names and how sensitive a literal they name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9, "token": 0.8,
    "apikey": 0.9, "accesskey": 0.9, "privatekey": 1.0, "secretkey": 1.0, "authkey": 0.9,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "authorization": 0.7,
    "signingkey": 0.9, "encryptionkey": 0.9, "masterkey": 0.9, "sessionkey": 0.8, "sshkey": 0.9,
    "dbpass": 0.9, "userpass": 0.9, "passcode": 0.9, "passkey": 0.9, "jwt": 0.8,
}
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|changeme|example|placeholder"
                          r"|your[ _-].*|none|null|true|false)\Z", _FLAGS)
#: From this score on, a quoted value counts whatever its spaces.
STRONG = 0.9
_SIGN = r":=|=>|->|(?<![=!<>])=(?!=)|:(?![:/])"
#: A sensitive name and all that can stand between it and an assignment sign.
_GATE = re.compile(r"(?:pass(?:word|wd|phrase|code|key)|(?:db|user)_?pass|pwd|secret|token|jwt"
                   r"|(?:api|access|private|auth|signing|encryption|master|session|ssh)"
                   r"[^A-Za-z0-9\s]*key|credential|bearer|authorization)"
                   rf"""(?:(?!{_SIGN})\S)*+(?:["')\]]|[^\S\n])*+(?P<sign>{_SIGN})?""", _FLAGS)
_LEX = re.compile(rf"""
    (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
  | (?P<assign>{_SIGN})
  | (?P<plus>\+(?!=))
  | (?P<line>\n|;)
  | (?P<bare>[^\s"'=:;,+()\[\]{{}}<>&|]+)
  | (?P<other>[^\s])
""", re.VERBOSE)
_NAME = r"(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)"
_QUOTED = r"""(?:"(?P<a>(?:[^"\\\n]|\\.)*+)"|'(?P<b>(?:[^'\\\n]|\\.)*+)')"""
_GAP = r"[^\S\n]*+"
#: One pattern per form: ``name``, and the literal as ``a`` or ``b``, or bare as ``c``.
FORMS = [re.compile(p, re.MULTILINE | re.DOTALL) for p in (
    # name = """text"""
    rf"""{_NAME}["')\]]*+{_GAP}(?:{_SIGN}){_GAP}[A-Za-z]{{0,2}}"""
    r"""(?:\"{3}(?P<a>.*?)\"{3}|'{3}(?P<b>.*?)'{3})""",
    # name: | and the deeper lines that follow
    rf"""^(?P<ind>[ \t]*+)(?:-[ \t]+)?["']?(?P<name>[A-Za-z_][\w.-]*+)["']?:{_GAP}[|>][-+0-9]*+{_GAP}\n"""
    r"(?P<a>(?:(?P=ind)[ \t]++[^\s][^\n]*+(?:\n|\Z)|[ \t]*+\n)++)",
    # define a macro
    rf"^{_GAP}#{_GAP}define[ \t]++(?P<name>\w++)[ \t]++(?:{_QUOTED}|(?P<c>\S++))",
    # option and value
    rf"(?<!\S)--(?P<name>[A-Za-z][\w-]*+)[ \t]++(?:{_QUOTED}|(?P<c>[^\s\"'-]\S*+))",
    # <name>text</name>
    r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?P<a>[^<>]++)</(?P=name)\s*+>",
    # name == "text"
    rf"""{_NAME}["')\]]*+{_GAP}[=!]==?{_GAP}{_QUOTED}""",
    # set_name("text"), obj.name("text")
    rf"{_NAME}(?P<call>\(){_GAP}{_QUOTED}{_GAP}\)",
    # name = call("text"
    rf"""{_NAME}["')\]]*+{_GAP}(?:{_SIGN}){_GAP}(?:new[ \t]++)?(?P<of>[A-Za-z_$][\w$.]*+)\({_GAP}{_QUOTED}""",
    # the password of scheme://user:password@host
    r"""(?<=://)[^\s/:@"'<>]*+:(?P<url>[^\s/@"'<>]++)@""",
    r"(?P<pem>-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,\\-])++"
    r"-----END (?:[A-Z0-9]++ )*?PRIVATE KEY-----)",
)]
_TUPLE = re.compile(rf"^{_GAP}(?P<names>[A-Za-z_$][\w$.]*+(?:{_GAP},{_GAP}[A-Za-z_$][\w$.]*+)++){_GAP}=(?!=)"
                    rf"{_GAP}\(?", re.MULTILINE)
_VALUE = re.compile(rf"{_GAP}(?:{_QUOTED}|[^,\n\"'()]*+){_GAP}(?P<more>,)?")
#: Texts without any of these hold none of the forms.
_HINT = re.compile(r"pass|pwd|secret|token|key|credential|bearer|authorization|jwt|://", _FLAGS)
#: Calls that look a value up by the name they are given.
_LOOKUP = re.compile(r"get|env|load|read|fetch|find|look|input|prompt|has|is_|check|require|delete|remove"
                     r"|print|log|error|exception|raise|assert|len|ask", _FLAGS)
_UNQUOTED = re.compile(r"""[^\s"';,()\[\]{}<>]+""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, in span order."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
           if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
            if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def name_score(name: str) -> float:
    """How sensitive a name is: its parts, alone and joined with the next."""
    parts = [p.lower() for p in _WORDS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


def literal_score(value: str, spaced: bool = False) -> float:
    """0 for empty, short or placeholder values, and for spaced-out ones unless
    ``spaced``; up to 1 for random ones."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or not spaced and value.count(" ") > 2:
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value),
                           re.search("[0-9]", value), re.search("[^A-Za-z0-9 ]", value))))
    return min(1.0, 0.15 * entropy + 0.15 * kinds)


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], str | None, bool]]:
    """(name, literal pieces as (start, end), name it is copied from, quoted)."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text)]
    out = []
    for i, (kind, start, end) in enumerate(tokens):
        if kind != "assign" or not i:
            continue
        j = i - 1
        while j and tokens[j][0] == "other" and text[tokens[j][1]] in ")]":
            j -= 1
        left, a, b = tokens[j]
        if left == "string":
            a, b = a + 1, b - 1
        if left not in ("name", "string") or " " in text[a:b]:
            continue
        name, pieces, source, quoted = text[a:b], [], None, False
        k, glued = i + 1, True
        while k < len(tokens):
            kind, a, b = tokens[k]
            if kind == "string" and (glued or quoted):
                if b - a > 2:
                    pieces.append((a + 1, b - 1))
                glued, quoted = False, True
            elif kind == "plus" and (quoted or source) and not glued:
                glued = True
            elif kind in ("name", "bare") and glued and not pieces and source is None:
                b = _UNQUOTED.match(text, a).end()
                while k + 1 < len(tokens) and tokens[k + 1][1] < b:
                    k += 1
                if re.fullmatch(r"[A-Za-z_$][\w$.]*", text[a:b]):
                    source = text[a:b]
                pieces.append((a, b))
                glued = False
            else:
                break
            k += 1
        if pieces:
            out.append((name, pieces, source, quoted))
    return out


def lexed_literals(text: str, threshold: float = 0.75,
                   begun: list[tuple[int, int]] = []) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that sensitive names receive, and,
    whatever their score, of those whose start one of ``begun`` takes: spans in
    order, without overlaps, from before the literal into it.

    Names are followed both ways a constant travels: a literal named ``a``
    counts for ``secret`` after ``secret = a``, in any order, through chains
    and cycles.
    """
    if not begun and not any(m["sign"] for m in _GATE.finditer(text)):
        return []
    starts = [x for x, _ in begun]
    pairs = assignments(text)
    assigned = {name for name, *_ in pairs}
    gives: dict[str, set[str]] = {}
    for name, _, source, quoted in pairs:
        if source in assigned and not quoted and source != name:
            gives.setdefault(source, set()).add(name)
    best: dict[str, float] = {}

    def reach(name: str) -> float:
        if name not in best:
            seen, todo = {name}, [name]
            while todo:
                for to in gives.get(todo.pop(), ()):
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            best[name] = max(map(name_score, seen))
        return best[name]

    found: dict[tuple[int, int], float] = {}
    for name, pieces, source, quoted in pairs:
        if source in assigned and not quoted:
            continue  # a reference, not a literal
        sensitive = reach(name)
        before = bisect_left(starts, pieces[0][0])
        cut = before > 0 and pieces[0][0] < begun[before - 1][1] < pieces[0][1]
        if not sensitive and not cut:
            continue
        random = literal_score("".join(text[a:b] for a, b in pieces),
                               quoted and sensitive >= STRONG)
        if not quoted and not re.search(r"[0-9]", text[pieces[0][0]:pieces[-1][1]]):
            random = 0.0  # plain words after a colon are prose
        score = 0.5 * sensitive + 0.5 * random if random else 0.0
        for piece in pieces if score >= threshold or cut else ():
            found[piece] = max(score, found.get(piece, 0.0))
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def form_literals(text: str, threshold: float = 0.75) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that the patterned forms give to sensitive names."""
    if not _HINT.search(text):
        return []
    out: dict[tuple[int, int], float] = {}

    def add(name: str, a: int, b: int, quoted: bool) -> None:
        sensitive = name_score(name)
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if not sensitive or not quoted and not re.search(r"[0-9]", text[a:b]):
            return
        random = literal_score(text[a:b], quoted and sensitive >= STRONG)
        if random and 0.5 * sensitive + 0.5 * random >= threshold:
            out[a, b] = 0.5 * sensitive + 0.5 * random

    for form in FORMS:
        for m in form.finditer(text):
            got = m.groupdict()
            if got.get("pem"):
                out[m.span("pem")] = 1.0
            elif got.get("url"):
                add("password", *m.span("url"), True)
            elif got.get("call") and _LOOKUP.match(got["name"].rpartition(".")[2]):
                continue
            elif not (got.get("of") and _LOOKUP.search(got["of"])):
                kind = next((k for k in "abc" if got.get(k)), None)
                if kind:
                    add(got["name"], *m.span(kind), kind != "c")
    for m in _TUPLE.finditer(text):
        at = m.end()
        for name in re.split(r"[^\S\n]*,[^\S\n]*", m["names"]):
            value = _VALUE.match(text, at)
            for kind in "ab":
                if value[kind]:
                    add(name, *value.span(kind), True)
            if not value["more"]:
                break
            at = value.end()
    return [(a, b, s) for (a, b), s in sorted(out.items())]


def all_spans(text: str | None, threshold: float = 0.75) -> list[tuple[int, int, str, float]]:
    """Base spans (score 1) and the literals that none of them covers whole."""
    text = text or ""
    base = base_spans(text)
    out = [(a, b, kind, 1.0) for a, b, kind in base]
    begun = [(a, b) for a, b, kind in base if kind == "assign"]
    for a, b, score in lexed_literals(text, threshold, begun):
        if not any(x <= a and b <= y for x, y, _ in base):
            out.append((a, b, "literal", score))
    held = sorted((a, b) for a, b, _, _ in out)
    reach = list(accumulate((b for _, b in held), max))
    for a, b, score in form_literals(text, threshold):
        i = bisect_left(held, (a + 1,))  # spans that start at or before a
        if i == 0 or reach[i - 1] < b:
            out.append((a, b, "literal", score))
    return _ordered(out)


def find_secrets(docs: DataFrame, threshold: float = 0.75, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """Adds ``secrets``: every span with kind, start, end and score."""
    def make():
        def run(texts):
            return [[[{"kind": k, "start": a, "end": b, "score": s}
                      for a, b, k, s in all_spans(t, threshold)] for t in texts]]
        return run

    return annotate(docs, make,
                    "secrets array<struct<kind:string,start:int,end:int,score:double>>",
                    text_col, keep)


def redact_text(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "<SECRET>", threshold: float = 0.75,
           text_col: str = "text") -> DataFrame:
    """Replaces every secret span by ``mark``; all rows and columns stay, and
    ``n_chars``, where the table has it, follows a changed text."""
    own, place = set_aside(docs, ["__hit"])

    def make():
        def run(texts):
            clean = [redact_text(t, [(a, b) for a, b, *_ in all_spans(t, threshold)], mark)
                     for t in texts]
            return [clean, [c != t for c, t in zip(clean, texts)]]
        return run

    out = annotate(own, make, f"`{text_col}` string, __hit boolean", text_col,
                   [c for c in own.columns if c != text_col])
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col("__hit"), F.length(f"`{text_col}`"))
                                 .otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType))
    return out.select(*[F.col(f"`{place[c]}`").alias(c) for c in docs.columns])
