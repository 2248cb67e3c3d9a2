"""G1-G7, G11-G15 of whole Go files in one pass over their bytes.

The rules are those of ``gofacts`` and ``gotypes``. A task blanks the comments
and literals of its files, cuts them into arrays of lines, and finds depths,
declarations, signatures and type declarations as running values. Only the
lines of signatures and types are tokenized. What leaves the task is one row
per function, package clause, import, type and field and, if asked for, per
parameter and call (column ``what``).
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from ..functions import patterns as P
from .filescan import Lines, in_order, run_numbers, segments, whole_runs, words

_POS = pa.struct([("line", pa.int32()), ("i", pa.int32())])
_TEXTS = pa.list_(pa.string())
_SCHEMA = pa.schema([
    ("fid", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("pkg", pa.string()), ("what", pa.string()),
    ("name", pa.string()), ("line", pa.int32()), ("nth", pa.int32()),
    # functions
    ("recv", pa.string()), ("recv_cc", pa.string()), ("lines", pa.int32()), ("complexity", pa.int32()),
    # imports
    ("import_alias", pa.string()), ("import_path", pa.string()),
    # types and fields
    ("head_pos", _POS), ("kind", pa.string()), ("top", pa.bool_()), ("alias", pa.bool_()), ("type_params", _TEXTS), ("to_qual", pa.string()),
    ("to_name", pa.string()), ("names", _TEXTS), ("embedded", pa.bool_()), ("type", pa.string()), ("ptr", pa.bool_()), ("qual", pa.string()),
    ("base", pa.string()), ("instance", pa.bool_()),
    # parameters
    ("func", pa.string())])
FOUND = ", ".join(f"{f.name} " + ("struct<line:int,i:int>" if f.type == _POS else "array<string>" if f.type == _TEXTS else
                                  {"int64": "long", "int32": "int", "bool": "boolean"}.get(str(f.type), "string")) for f in _SCHEMA)

_DECLS = [b"func", b"type", b"var", b"const", b"import", b"package"]
#: The words that are counted or looked for in a line.
_SIZES = {w: len(w) for w in ("if", "for", "case", "type")}
_SIZE_BY_LETTER = np.zeros(256, np.int64)
for _w, _n in _SIZES.items():
    _SIZE_BY_LETTER[ord(_w[0])] = _n
_ID_BYTE = np.array([chr(c).isalnum() or c == 95 for c in range(128)] + [False] * 128)
#: Comments and literals; what lies between the marks of an open one is code (as in ``patterns.GO_CHUNK``).
_LITERAL = re.compile(P.GO_CHUNK.rsplit("|", 2)[0].encode())
_BLANK = bytes(10 if c == 10 else 32 for c in range(256))
_KEPT = {*"{}()[];,.*=", "&&", "||", "\n"}


@functools.cache
def _class(*categories: str) -> str:
    """The characters of some Unicode categories, as the inside of a character class."""
    found = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(categories)]
    out = []
    for _, run in itertools.groupby(enumerate(found), lambda x: x[1] - x[0]):
        span = [c for _, c in run]
        out.append(f"{chr(span[0])}-{chr(span[-1])}")
    return ("A-Za-z" if "L" in categories else "") + ("0-9" if "Nd" in categories else "") + "".join(out)


@functools.cache
def _pattern(pattern: str, ascii_only: bool) -> re.Pattern:
    """A Java pattern of this library: its classes of letters and digits are spelled out, for ASCII texts without the others."""
    letters, digits = ("A-Za-z", "0-9") if ascii_only else (_class("L"), _class("Nd"))
    return re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{Nd}", digits).replace(r"\w", "A-Za-z0-9_"), re.ASCII)


def _in(pattern: str, text: str) -> re.Pattern:
    return _pattern(pattern, text.isascii())


_SIG = r"[ \t]*func[ \t]*(?:\(([^)]*)\))?[ \t]*(" + P.GO_ID + ")"
_NAMED = P.GO_ID + r"[ \t]+(?=\S)"
_PLAIN, _INDEXED = P.GO_ID, "(" + P.GO_ID + r")\[[^,\[\]]+\]"
_CLAUSE = r"package[ \t]+(" + P.GO_ID + ")"
_CALL = r"(?<![\p{L}\p{Nd}_.])(" + P.GO_ID + r"\." + P.GO_ID + r")[ \t]*\("
_TYPE_LINE = r"(?:^|[{;])[ \t]*type" + P.GO_NOT_ID_AFTER
_IMPORT = "^[ \t]*import" + P.GO_NOT_ID_AFTER
_SPEC = r'(?:^|[ \t(;])(?:(\.|' + P.GO_ID + r')[ \t]+)?["`]([^"`]+)["`]'
_FIELD_TYPE = r"(\* )?(?:(" + P.GO_ID + r") \. )?(" + P.GO_ID + r")( \[ .* \])?"
_LAST_NAME = r"(?:" + P.GO_ID + r"\.)?" + P.GO_ID + r"\Z"
_EOL = "\n\r\x85\u2028\u2029"
_IMPORT_COMMENT = re.compile(rf"//[^{_EOL}]*(?=(?:\r\n|[{_EOL}])?\Z)|/\*[^{_EOL}]*?\*/")


def tokens(text: str) -> list[str]:
    """The tokens of a masked line that are kept (``patterns.GO_KEEP``), closed by a newline."""
    found = [t for t in _in(P.GO_TOKEN_ANALYSIS, text).findall(text) if t in _KEPT or t[0] == "_" or t[0].isalpha()]
    found.append("\n")
    return found


def is_ident(tok: str | None) -> bool:
    """For tokens: only identifiers start like one."""
    return tok is not None and (tok[0] == "_" or tok[0].isalpha())


def type_text(toks: list[str]) -> str:
    """G13, the fold of ``gotypes.type_text``."""
    out, hide, done, last = "", 0, False, ""
    for t in toks:
        opens, closes = t in ("(", "[", "{"), t in (")", "]", "}")
        key = t == "[" and last == "map"
        if hide:
            hide += opens - closes
            last = t
            continue
        if t == "]":
            out += t
        elif done or t in ("\n", "{"):
            pass
        elif t == "func":
            out += "func(...)"
        elif t == "interface":
            out += "interface{}"
        elif t == "struct" or t == "(":
            out += "?"
        elif t == "chan":
            out += "chan "
        elif t == "[" and last and is_ident(last) and last not in P.GO_TYPE_WORDS:
            out = _in(_LAST_NAME, out).sub("?", out)
        elif t == "[" and not key:
            out += "[]"
        else:
            out += t
        hide = int(opens and not key)
        done = False if t == "]" else done or t == "func"
        last = t
    return out


_DELTA = {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}


Token = tuple[int, int, str, int]  # line, place in it, text, number of the row it comes from


def line_tokens(rows: list[tuple[int, str]]) -> list[Token]:
    """Tokens of masked lines (number, text) in the order of line and place."""
    out = [(line, i, t, k) for k, (line, text) in enumerate(rows) for i, t in enumerate(tokens(text))]
    if any(b[0] <= a[0] for a, b in zip(rows, rows[1:])):  # lines of several files
        out.sort(key=lambda t: t[:2])
    return out


def type_facts(toks: list[Token], tops: list[bool], pkgs: list[str | None], named: bool) -> tuple[list[tuple], list[tuple]]:
    """Types and struct fields from the tokens of one file's type declarations.

    types: (pkg, name, line, pos, kind, top, alias, type parameters, to_qual, to_name); fields: (pkg, struct, line, pos, field
    number, type parameters, names, embedded, type, ptr, qual, base, instance). In a file without a name (not
    ``named``) nothing is looked up by a type's place: its types have no fields or parameters."""
    texts = [t[2] for t in toks] + [None] * 4
    depth, prev, grp, grp_closed, head, hopen, hclose = 0, None, None, None, None, None, None
    heads, closers, params, generics, bodies = [], {}, {}, {}, {}
    for n, (line, i, tok, row) in enumerate(toks):
        pos, before = (line, i), depth
        depth += _DELTA.get(tok, 0)
        if tok == "(" and prev == "type":
            grp = (pos, depth)
        if grp and tok == ")" and depth == grp[1] - 1:
            grp_closed = pos
        ident = is_ident(tok)
        if ident and tok not in ("type", "struct", "interface") and (prev == "type" or (
                prev in ("\n", ";", "(") and grp and (grp_closed is None or grp_closed < grp[0]) and before == grp[1])):
            head = (pos, before)
            after = tuple(texts[n + 1:n + 5])
            heads.append((pos, tok, row, after))
            if after[0] == "[" and is_ident(after[1]) and (is_ident(after[2]) or after[2] in (",", "[")):
                generics.setdefault(pos, []).append(n)
                heads[-1] += (True,)
            else:
                heads[-1] += (False,)
        if head:
            at, level = head
            if tok == "{" and before == level:
                hopen = pos
            if tok == "}" and depth == level:
                hclose = pos
            inside = hopen is not None and hopen > at and (hclose is None or hclose < at) and before >= level + 1
            if inside:
                bodies.setdefault(at, []).append((pos, tok, before == level + 1))
            elif tok == "]" and depth == level:
                closers.setdefault(at, tuple(texts[n + 1:n + 5]))
            elif ident and prev in ("[", ",") and before == level + 1:
                params.setdefault(at, {})[tok] = None
        prev = tok

    types = []
    for pos, name, row, plain, generic in heads:
        joined = generics.get(pos, []) if named else []
        after = closers.get(pos) if generic and joined else None
        at = after or plain
        alias = at[0] == "="
        at = (*at[1:], None) if alias else at
        kind = "struct" if at[0] == "struct" and at[1] == "{" else "interface" if at[0] == "interface" else "other"
        qual = base = None
        ends = ("\n", ";", ")", "[", "}")
        if is_ident(at[0]) and at[0] not in P.GO_TYPE_WORDS:
            if at[1] == "." and is_ident(at[2]) and (at[3] is None or at[3] in ends):
                qual, base = at[0], at[2]
            elif at[1] is None or at[1] in ends:
                qual, base = "", at[0]
        one = (pkgs[row], name, pos[0], pos, kind, tops[row], alias, list(params.get(pos, ())) if joined else [], qual, base)
        types += [one] * max(1, len(joined))

    fields = []
    for st in types if named else []:
        if st[4] != "struct":
            continue
        no, parts = 0, {}
        for tok in bodies.get(st[3], ()):
            if tok[2] and tok[1] in ("\n", ";"):
                no += 1
            elif tok[1] != "\n":
                parts.setdefault(no, []).append(tok)
        fields += [(st[0], st[1], min(t[0][0] for t in ts), st[3], no, st[7], *f) for no, ts in parts.items() if (f := _field(sorted(ts)))]
    return types, fields


def _field(ts: list[tuple]) -> tuple | None:
    """(names, embedded, type, ptr, qual, base, instance) of one field declaration's tokens (pos, text, at field level)."""
    every, toks = [t[1] for t in ts], [t[1] for t in ts if t[2]]
    if not toks:
        return None
    n = len(toks)
    # Embedded: *T, T, pkg.T, and instances T[...] (nothing follows the bracket at field level).
    embedded = toks[0] == "*" or n == 1 or toks[1] == "." or (toks[1] == "[" and n == 2)
    names, full = [], every
    if not embedded:
        # The type starts at the first place not adjacent to a comma.
        start = next((i for i in range(1, n) if toks[i] != "," and toks[i - 1] != ","), n)
        names, full = [t for t in toks[:start] if t != ","], every[start:]
    spaced = " ".join(full)
    m = _in(_FIELD_TYPE, spaced).fullmatch(spaced)
    base = m[3] if m and m[3] not in P.GO_TYPE_WORDS else ""
    return names, embedded, type_text(full), spaced.startswith("* "), (m and m[2]) or "", base, bool(m and m[4])


def params_of(toks: list[Token]) -> list[tuple]:
    """G12 of one signature's tokens: (function, index, name or None, type)."""
    depth, name, opened, idx = 0, None, 0, 0
    parts: dict[int, list] = {}
    for line, i, tok, _ in toks:
        if tok == "\n":
            continue
        before = depth
        depth += _DELTA.get(tok, 0)
        if name is None and before == 0 and tok != "func" and is_ident(tok):
            name = tok
        if name is not None:
            if tok == "(" and before == 0:
                opened += 1
            if tok == ")" and depth == 0:
                break
        if opened == 1 and before >= 1:
            if tok == "," and before == 1:
                idx += 1
            else:
                parts.setdefault(idx, []).append((line, i, tok, depth))
    texts, own = {}, {}
    for idx, ts in parts.items():
        ts.sort()
        toks = texts[idx] = [t[2] for t in ts]
        second, third = (toks + [None, None])[1:3]
        # In ``a [n]T`` the bracket closes before the end, in the instance ``T[K]`` at the end.
        closes = next((k for k, t in enumerate(ts, 1) if t[2] == "]" and t[3] == 1), 0)
        if is_ident(toks[0]) and toks[0] not in P.GO_TYPE_WORDS and (
                is_ident(second) or second in ("*", "(") or (second == "[" and closes < len(ts)) or (second == "." and third == ".")):
            own[idx] = type_text(toks[1:])
    out, following = [], None
    for idx in sorted(texts, reverse=True):
        following = own.get(idx, following)
        out.append((name, idx, texts[idx][0] if own else None, following if own else type_text(texts[idx])))
    return out[::-1]


@functools.lru_cache(4096)
def _receiver_names(recv: str) -> tuple[str, str]:
    """The type's name from the text between a receiver's parentheses, and the one that is empty where the type has an index."""
    recv = recv.strip(" ")
    recv = _in(_NAMED, recv).sub("", recv, count=1) if _in(_NAMED, recv).match(recv) else recv
    base = recv.replace(" ", "").replace("\t", "").lstrip("*")
    plain = base if _in(_PLAIN, base).fullmatch(base) else ""
    index = _in(_INDEXED, base).fullmatch(base)
    return plain or (index[1] if index else ""), plain


def receiver(head: str) -> tuple[str, str | None, str | None] | None:
    """(name, receiver, receiver without an index) of a signature's text; None without a name."""
    m = _in(_SIG, head).match(head)
    if not m:
        return None
    return (m[2], None, None) if m[1] is None else (m[2], *_receiver_names(m[1]))


def scanner(detail: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of FOUND of the files (fid, repo, path, dir, content), which come in the order of their key; ``detail``: also parameters and calls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, dirs, texts in whole_runs(batches, ["fid", "repo", "path"], ["dir"]):
            yield from facts(keys, [d for d, in dirs], texts, detail)
    return run


def _whole_words(ls: Lines, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Those starts of ASCII words that no other letter or digit touches."""
    before, behind = ls.a[at - 1], ls.a[at + size]  # the first line's "before" is the closing newline
    odd = np.flatnonzero((before > 127) | (behind > 127))
    keep = np.ones(len(at), bool)
    for k in odd.tolist():
        line = np.searchsorted(ls.end, at[k])
        n = size if isinstance(size, int) else int(size[k])
        left = ls.raw[ls.start[line]:at[k]].decode("utf-8", "replace")[-1:]
        right = ls.raw[at[k] + n:ls.end[line]].decode("utf-8", "replace")[:1]
        keep[k] = not any(c > "\x7f" and (c.isalpha() or c.isdecimal()) for c in (left, right))
    return keep


def _words(ls: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of _SIZES and their first letters, which tell them apart."""
    at = words(ls.a, _ID_BYTE, list(_SIZES))
    letter = ls.a[at]
    keep = _whole_words(ls, at, _SIZE_BY_LETTER[letter])
    return at[keep], letter[keep]


def _pairs(ls: Lines, mark: int) -> np.ndarray:
    """Lines of the double marks (&&, ||), each as often as it holds one."""
    at = np.flatnonzero(ls.a == mark)
    if not len(at):
        return at
    _, first = segments(np.append(True, np.diff(at) > 1))
    return np.repeat(np.searchsorted(ls.end, at[first]), np.diff(np.append(first, len(at))) // 2)


def line_states(keys: list[tuple], texts: list[bytes]) -> SimpleNamespace:
    """The lines of masked files in the order of their file, with brackets, cc tokens, depths and declarations (rows are
    named by their place; -1 stands for none). ``kw`` is the number of the declaration's word in ``_DECLS``."""
    ls = Lines([_LITERAL.sub(lambda m: m[0].translate(_BLANK), t) for t in texts])
    n = len(ls.end)
    per_line = lambda at: np.bincount(np.searchsorted(ls.end, at), minlength=n)
    count = {c: per_line(np.flatnonzero(ls.a[:len(ls.raw)] == ord(c))) for c in "{}()[]"}
    bd = count["{"] - count["}"]
    dl = bd + count["("] - count[")"] + count["["] - count["]"]
    cc = sum(np.bincount(_pairs(ls, ord(c)), minlength=n) for c in "&|")
    spot, letter = _words(ls)
    cc = cc + per_line(spot[letter != ord("t")])
    lead = ls.lead()
    first = np.full(n, -1)
    for k, word in enumerate(_DECLS):
        some = np.flatnonzero(ls.starting(lead, word))
        behind = lead[some] + len(word)
        some = some[~_ID_BYTE[ls.a[behind]]]
        first[some[_whole_words(ls, lead[some], len(word))]] = k

    def text(i: int) -> str:
        return ls.raw[ls.start[i]:ls.end[i]].decode("utf-8", "surrogateescape")

    # Lines in the order of their file; everything below is in this order.
    run, no = run_numbers(keys)[ls.file], ls.no
    of = in_order(run, no)
    several = of is not None
    of = np.arange(n) if of is None else of
    run, no, bd, dl, cc, first = run[of], no[of], bd[of], dl[of], cc[of], first[of]
    opens, closes = count["{"][of] > 0, count["}"][of] > 0
    new = np.append(True, run[1:] != run[:-1])
    run_of, begin = segments(new)
    begin = begin[run_of]

    def running(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - (total - x)[begin]

    def latest(flag: np.ndarray, before: bool = False) -> np.ndarray:
        """The last row of the file so far (or before this one) that has the flag, -1 if none."""
        at = np.maximum.accumulate(np.where(flag, np.arange(n), -1))
        if before:
            at = np.append(-1, at[:-1])
        return np.where(at >= begin, at, -1)
    depth, bdepth = running(dl), running(bd)
    before, bbefore = depth - dl, bdepth - bd
    start = (before == 0) & (first >= 0)
    body_open = opens & (bbefore == 0) & (depth == bd)
    inner = np.zeros(n, bool)
    has_type = per_line(spot[letter == ord("t")]) > 0
    for r in np.flatnonzero(has_type[of] & ((first != 1) | (before > 0))).tolist():
        t = text(of[r])
        inner[r] = _in(_TYPE_LINE, t).search(t) is not None
    decl = latest(start)
    kw = np.where(decl >= 0, first[decl], -1)
    ts = latest(inner)
    is_func = kw == 0
    sig = is_func & (latest(body_open, before=True) < decl)
    ends = (ts >= 0) & (no >= no[ts]) & (depth <= before[ts])
    closed = latest(ends, before=True)
    top = kw == 1
    region = top | ((ts >= 0) & (np.where(closed >= 0, no[closed], -1) < no[ts]))
    return SimpleNamespace(ls=ls, of=of, several=several, run=run, no=no, file=ls.file[of], text=text, begin=begin, bd=bd, cc=cc, first=first,
                           opens=opens, closes=closes, depth=depth, bbefore=bbefore, start=start, decl=decl, kw=kw, sig=sig, top=top, region=region)


def facts(keys: list[tuple], dirs: list, texts: list[bytes], detail: bool) -> Iterator[pa.RecordBatch]:
    s = line_states(keys, texts)
    ls, of, several, run, no, file, text, n = s.ls, s.of, s.several, s.run, s.no, s.file, s.text, len(s.no)
    cc, opens, closes, depth, start, decl, kw, sig, first = s.cc, s.opens, s.closes, s.depth, s.start, s.decl, s.kw, s.sig, s.first
    is_func = kw == 0

    def rows(what: str, files: list[int], **columns) -> pa.RecordBatch:
        made = {k: pa.array([keys[f][j] for f in files], _SCHEMA.field(k).type) for j, k in enumerate(("fid", "repo", "path"))}
        made |= {k: v if isinstance(v, pa.Array) else pa.array(v, _SCHEMA.field(k).type) for k, v in columns.items()}
        made["what"] = pa.array([what] * len(files), pa.string())
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(files), f.type) for f in _SCHEMA], schema=_SCHEMA)

    # Functions: the rows of a declaration (of one folder, should files of one key lie in several).
    group = decl.copy()
    if several:
        folder: dict = {}
        number = np.array([folder.setdefault(d, len(folder)) for d in dirs])[file]
        group = np.where(decl >= 0, decl * len(folder) + number, -1)
    useful = np.flatnonzero(is_func & (sig | (cc > 0) | opens | closes))
    ids, at = np.unique(group[useful], return_inverse=True)
    total = np.bincount(at, cc[useful], len(ids)).astype(np.int64)
    brace = np.bincount(at, opens[useful], len(ids)) > 0
    last = np.full(len(ids), -1)
    zero = closes[useful] & (depth[useful] == 0)
    np.maximum.at(last, at[zero], no[useful[zero]])
    head_row = np.zeros(len(ids), np.int64)
    head_row[at[::-1]] = useful[::-1]
    line = no[decl[head_row]]
    # Most signatures lie on the declaration's first line.
    heads = {g: text(r) for g, r in zip(np.flatnonzero(brace).tolist(), of[head_row[brace]].tolist())}
    signed = sig[useful]
    long = np.flatnonzero(np.bincount(at[signed], minlength=len(ids)) > 1)
    if len(long):
        several_lines: dict[int, list] = {g: [] for g in long.tolist()}
        for g, r in zip(at[signed].tolist(), useful[signed].tolist()):
            if g in several_lines:
                several_lines[g].append((int(no[r]), text(of[r])))
        heads |= {g: " ".join(t for _, t in sorted(ts)) for g, ts in several_lines.items() if g in heads}
    found = {g: f for g, h in heads.items() if (f := receiver(h)) is not None}
    if found:
        g = np.array(list(found))
        name, recv, recv_cc = zip(*found.values())
        f = file[head_row[g]].tolist()
        yield rows("func", f, pkg=[dirs[x] for x in f], name=name, recv=recv, recv_cc=recv_cc, line=line[g],
                   lines=pa.array(last[g] - line[g] + 1, pa.int32(), mask=last[g] < 0), complexity=total[g] + 1)

    # Package clauses: one row per file and folder.
    clause: dict[tuple, list] = {}
    for f, d in enumerate(dirs):
        clause.setdefault((keys[f], d), [f, None])
    for r in np.flatnonzero(start & (first == 5)).tolist():
        t, f = text(of[r]), int(file[r])
        if m := _in(_CLAUSE, t).search(t):
            one = clause[keys[f], dirs[f]]
            one[1] = min(x for x in (one[1], (int(no[r]), m[1])) if x)
    yield rows("package", [f for f, _ in clause.values()], pkg=[dirs[f] for f, _ in clause.values()], name=[c and c[1] for _, c in clause.values()])

    # Imports, from the raw lines.
    imports = []
    imp = np.flatnonzero(kw == 4)
    if len(imp):
        raw = b"\n".join(texts)  # blanks are as long as what they stand for
        for r in imp.tolist():
            t = raw[ls.start[of[r]]:ls.end[of[r]]].decode("utf-8", "surrogateescape")
            t = _IMPORT_COMMENT.sub(" ", t)
            t = _in(_IMPORT, t).sub(" ", t)
            imports += [(int(file[r]), int(no[r]), k, m[1] or None, m[2]) for k, m in enumerate(_in(_SPEC, t).finditer(t))]
    if imports:
        f, line, nth, alias, path = zip(*imports)
        yield rows("import", f, line=line, nth=nth, import_alias=alias, import_path=path)

    # Types and fields, file by file.
    types, fields = [], []
    some = np.flatnonzero(s.region)
    for part in np.split(some, np.flatnonzero(np.diff(run[some])) + 1) if len(some) else []:
        part = part.tolist()
        f = int(file[part[0]])
        t, g = type_facts(line_tokens([(int(no[r]), text(of[r])) for r in part]), s.top[part].tolist(),
                          [dirs[x] for x in file[part].tolist()], None not in keys[f])
        types += [(f, *x) for x in t]
        fields += [(f, *x) for x in g]
    if types:
        f, pkg, name, line, pos, kind, tops, alias, type_params, qual, base = zip(*types)
        yield rows("type", f, pkg=pkg, name=name, line=line, head_pos=_places(pos), kind=kind, top=tops, alias=alias, type_params=type_params,
                   to_qual=qual, to_name=base)
    if fields:
        f, pkg, name, line, pos, nth, type_params, names, embedded, kind, ptr, qual, base, instance = zip(*fields)
        yield rows("field", f, pkg=pkg, name=name, line=line, head_pos=_places(pos), nth=nth, type_params=type_params, names=names,
                   embedded=embedded, type=kind, ptr=ptr, qual=qual, base=base, instance=instance)
    if not detail:
        return

    # Parameters and calls, by the line of the function.
    heads: dict[tuple[int, int], list[int]] = {}
    for r in np.flatnonzero(sig).tolist():
        heads.setdefault((int(run[r]), int(no[decl[r]])), []).append(r)
    params = [(int(file[rs[0]]), line, *p) for (_, line), rs in heads.items()
              for p in params_of(line_tokens([(int(no[r]), text(of[r])) for r in rs]))]
    if params:
        f, line, func, nth, name, kind = zip(*params)
        yield rows("param", f, func=func, line=line, nth=nth, name=name, type=kind)
    dotted = np.zeros(n, bool)
    dotted[np.searchsorted(ls.end, np.flatnonzero(ls.a == 46))] = True
    calls: dict[tuple[int, int], dict[str, tuple]] = {}
    for r in np.flatnonzero(dotted[of] & is_func).tolist():
        t = text(of[r])
        for k, call in enumerate(_in(_CALL, t).findall(t)):
            seen = calls.setdefault((int(s.begin[r]), int(no[decl[r]])), {})
            seen[call] = min(seen.get(call, (int(no[r]), k)), (int(no[r]), k))
    ranked = [(int(file[b]), line, call, rank) for (b, line), seen in calls.items()
              for rank, (call, _) in enumerate(sorted(seen.items(), key=lambda x: x[1]), 1)]
    if ranked:
        f, line, name, nth = zip(*ranked)
        yield rows("call", f, line=line, name=name, nth=nth)


def _places(pos: tuple) -> pa.Array:
    line, i = zip(*pos)
    return pa.StructArray.from_arrays([pa.array(line, pa.int32()), pa.array(i, pa.int32())], fields=list(_POS))
