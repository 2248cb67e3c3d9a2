"""P1-P14 and P6 of whole Python files in one pass over their bytes.

The rules are those of ``pyfacts`` (lines, indents, headers, bodies, scopes,
classes); a task reads its files, cut into arrays of lines, and gives the rows
that are left: one per file, class and def. No line leaves the task.

A scope of indent ``t`` is closed by the next line of code with an indent of
at most ``t``, so scopes and innermost classes are looked up, for every
header indent of the chunk, in the ordered positions of the lines that can
close it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import patterns as P
from .filescan import Lines, in_order, run_numbers, segments, whole_runs, words

FOUND = ("repo string, path string, what string, line int, name string, indent int, is_method boolean, complexity int, encl string, "
         "encl_line int, class string, methods int, fields int, end_line int")
_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in FOUND.split(", ")])

_BIG = 1 << 30
_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(128)] + [False] * 128)
# The patterns of the relational form, on bytes: their words and white space are ASCII.
_CLASS, _DEF, _METHOD, _FIELD = (re.compile(p.replace(r"\w", "[A-Za-z0-9_]").removeprefix("^").encode())
                                 for p in (P.PY_CLASS, P.PY_FUNC, P.PY_METHOD, P.PY_SELF_FIELD))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND of the files (repo, path, content), which come in the order of repo and path."""
    for keys, _, texts in whole_runs(batches, ["repo", "path"]):
        yield facts(keys, texts)


SIGNATURES = "repo string, path string, line int, signature string"
_EOL = "\n\r\x85\u2028\u2029"
#: String literals of one line, or a comment (a dot of Java's patterns matches no line end).
_LITERAL = re.compile(rf"""'[^'\\]*(?:\\[^{_EOL}][^'\\]*)*'|"[^"\\]*(?:\\[^{_EOL}][^"\\]*)*"|#[^{_EOL}]*(?=(?:\r\n|[{_EOL}])?\Z)""")
_DEF_TEXT = re.compile(P.PY_FUNC, re.ASCII)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SIGNATURES of the files (repo, path, content), which come in the order of repo and path."""
    for keys, _, texts in whole_runs(batches, ["repo", "path"]):
        found = list(_signatures(keys, texts))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))],
                                         names=["repo", "path", "line", "signature"])


def _signatures(keys: list[tuple], texts: list[bytes]) -> Iterator[tuple]:
    ls = Lines(texts)
    run, no = run_numbers(keys)[ls.file], ls.no
    of = in_order(run, no)
    of = np.arange(len(no)) if of is None else of
    run, no = run[of], no[of]

    def code(r: int) -> str:
        text = ls.raw[ls.start[of[r]]:ls.end[of[r]]].decode("utf-8", "surrogateescape")
        return _LITERAL.sub(" ", text) if "'" in text or '"' in text or "#" in text else text
    likely = np.zeros(len(no), bool)
    likely[np.searchsorted(ls.end, words(ls.a, _WORD, ["def"]))] = True
    heads = {r: c for r in np.flatnonzero(likely[of]).tolist() if _DEF_TEXT.match((c := code(r)).strip(P.GO_SPACE_CHARS))}
    for r, text in heads.items():
        parts, depth, k = [], 0, r
        while True:
            parts.append((int(no[k]), text))
            depth += sum(map(text.count, "([{")) - sum(map(text.count, ")]}"))
            k += 1
            if depth <= 0 or k == len(no) or run[k] != run[r] or k in heads:
                break
            text = code(k)
        yield *keys[ls.file[of[r]]], int(no[r]), " ".join(t for _, t in sorted(parts))


def _headers(ls: Lines, at: np.ndarray, code: np.ndarray) -> tuple[dict[int, bytes], dict[int, bytes], set[int]]:
    """(class name by line, def name by line, defs that are methods)."""
    raw, end = ls.raw, ls.end
    classes, defs, methods = {}, {}, set()
    for i in np.flatnonzero(code & ls.starting(at, b"class")).tolist():
        if m := _CLASS.match(raw, at[i], end[i]):
            classes[i] = m[1]
    for i in np.flatnonzero(code & ls.starting(at, b"def")).tolist():
        if m := _DEF.match(raw, at[i], end[i]):
            defs[i] = m[1]
            if _METHOD.match(raw, at[i], end[i]):
                methods.add(i)
    return classes, defs, methods


def _flags(n: int, some) -> np.ndarray:
    out = np.zeros(n, bool)
    out[list(some)] = True
    return out


def facts(keys: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
    ls = Lines(texts)
    indent, at = ls.indents()
    skip = (at >= ls.end) | (ls.a[at] == 35)
    class_names, def_names, method_lines = _headers(ls, at, ~skip)
    kw = np.bincount(np.searchsorted(ls.end, words(ls.a, _WORD, P.PY_CC_WORDS)), minlength=len(at))
    fields = [i for i in np.flatnonzero(ls.starting(at, b"self.") & (at > ls.start)).tolist() if _FIELD.match(ls.raw, ls.start[i], ls.end[i])]

    # Lines of code and the first line of every file, in the order of their file.
    of = np.flatnonzero(~skip | (ls.no == 1))
    run = run_numbers(keys)[ls.file[of]]
    order = in_order(run, ls.no[of])
    if order is not None:
        of, run = of[order], run[order]
    no, ind, code, kw = ls.no[of], indent[of], ~skip[of], kw[of]
    is_class, is_def, is_method, is_field = (_flags(len(at), x)[of] for x in (class_names, def_names, method_lines, fields))

    # A segment is what follows a def up to the next one.
    new = np.append(True, run[1:] != run[:-1])
    seg, first = segments(new | is_def)
    low = np.minimum.accumulate(np.where(is_def, _BIG, ind) - seg * 2 * _BIG) + seg * 2 * _BIG
    body = is_def[first][seg] & ~is_def & (low > ind[first][seg])
    complexity = 1 + np.bincount(seg, kw * (body & ~is_class)).astype(np.int64)

    # From here on lines of code only.
    of, run, no, ind, seg, is_class, is_def, is_method, field = (
        x[code] for x in (of, run, no, ind, seg, is_class, is_def, is_method, body & is_field))
    upto = np.arange(len(of))  # the last line of code of the same number in the file
    if order is not None:
        last = np.append((run[1:] != run[:-1]) | (no[1:] != no[:-1]), True)
        upto = np.flatnonzero(last)[np.append(0, np.cumsum(last)[:-1])] if len(of) else upto
    c, d = np.flatnonzero(is_class), np.flatnonzero(is_def)
    ends, inner = _ends(run, no, ind, np.flatnonzero(is_class | is_def)), _innermost(run, no, ind, is_class, c, d, upto)
    # Files without a repo or a path have no classes around their defs.
    named = np.array([None not in k for k in keys])[ls.file[of[d]]]
    inner[~named] = -1

    # The latest header of a name, by (file, name, line).
    ids: dict[bytes, int] = {}
    number = np.full(len(of), -1)
    number[c] = [ids.setdefault(class_names[i], len(ids)) for i in of[c].tolist()]
    far = int(no.max(initial=0)) + 1
    owned = is_method[d] & (inner >= 0)
    own_name = np.where(owned, number[inner], -1)
    init = owned & np.array([def_names[i] == b"__init__" for i in of[d].tolist()], bool)
    init_name = np.full(len(first), -1)
    init_name[seg[d[init]]] = own_name[init]
    f = np.flatnonzero(field)
    f = f[init_name[seg[f]] >= 0]
    place, spot = np.unique(run[c] * far + no[c], return_inverse=True)
    head = (run[c] * (len(ids) + 1) + number[c]) * far + no[c]
    by_head = np.argsort(head, kind="stable")

    def counted(rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        """For every class the rows whose name it owns."""
        look = (run[rows] * (len(ids) + 1) + names) * far
        p = np.searchsorted(head[by_head], look + no[rows], "right") - 1
        ok = p >= 0
        ok[ok] = head[by_head[p[ok]]] >= look[ok]
        return np.bincount(spot[by_head[p[ok]]], minlength=len(place))[spot]
    n_methods, n_fields = counted(d[owned], own_name[owned]), counted(f, init_name[seg[f]])

    return _batch(keys, ls.file[of], no, ind, c, d, ends,
                  files=np.arange(len(texts)), class_names=[class_names[i].decode() for i in of[c].tolist()],
                  def_names=[def_names[i].decode() for i in of[d].tolist()], is_method=is_method[d],
                  complexity=complexity[seg[d]], inner=inner, owned=owned, n_methods=n_methods, n_fields=n_fields)


def _ends(run: np.ndarray, no: np.ndarray, ind: np.ndarray, headers: np.ndarray) -> np.ndarray:
    """The line that closes each header's scope, -1 at the end of the file."""
    ends = np.full(len(run), -1)
    for t in np.unique(ind[headers]):
        closers, h = np.flatnonzero(ind <= t), headers[ind[headers] == t]
        p = np.searchsorted(closers, h, "right")
        h, p = h[p < len(closers)], p[p < len(closers)]
        same = run[closers[p]] == run[h]
        ends[h[same]] = no[closers[p[same]]]
    return ends


def _innermost(run: np.ndarray, no: np.ndarray, ind: np.ndarray, is_class: np.ndarray, c: np.ndarray, d: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The row of the innermost open class of each def, -1 without one. Defs of one file and line share theirs."""
    best = np.full(len(d), -1)
    for t in np.unique(ind[c]):
        closers, some = np.flatnonzero(ind <= t), np.flatnonzero(ind[d] > t)
        p = np.searchsorted(closers, upto[d[some]], "right") - 1
        some, p = some[p >= 0], p[p >= 0]
        top = closers[p]
        ok = (run[top] == run[d[some]]) & is_class[top] & (ind[top] == t)
        some, top = some[ok], top[ok]
        nearer = (best[some] < 0) | (no[top] > no[best[some]])
        best[some[nearer]] = top[nearer]
    group = upto[d]
    if len(np.unique(group)) < len(group):
        most: dict[int, int] = {}
        for g, b in zip(group.tolist(), best.tolist()):
            if b >= 0 and (g not in most or no[b] > no[most[g]]):
                most[g] = b
        best = np.array([most.get(g, -1) for g in group.tolist()])
    return best


def _batch(keys, file, no, ind, c, d, ends, *, files, class_names, def_names, is_method, complexity, inner, owned, n_methods, n_fields) -> pa.RecordBatch:
    """One row per file, class and def."""
    sizes = (len(files), len(c), len(d))

    def column(kind, *parts, null=None):
        """Values of the files, classes and defs; None stands for nulls, and so does the value ``null``."""
        arrays = [pa.nulls(n, kind) if x is None else
                  pa.array(x, kind, mask=(np.asarray(x) == null) if null is not None else None) for x, n in zip(parts, sizes)]
        return pa.concat_arrays(arrays)
    text, whole = pa.string(), pa.int32()
    by_class = dict(zip(c.tolist(), class_names))
    encl = [by_class.get(i) for i in inner.tolist()]
    where = np.concatenate([files, file[c], file[d]])
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], text).take(pa.array(where)), pa.array([k[1] for k in keys], text).take(pa.array(where)),
        column(text, ["file"] * sizes[0], ["class"] * sizes[1], ["def"] * sizes[2]),
        column(whole, None, no[c], no[d]), column(text, None, class_names, def_names), column(whole, None, ind[c], ind[d]),
        column(pa.bool_(), None, None, is_method), column(whole, None, None, complexity), column(text, None, None, encl),
        column(whole, None, None, np.where(inner >= 0, no[inner] if len(no) else -1, -1), null=-1),
        column(text, None, None, [e if o else "" for e, o in zip(encl, owned.tolist())]),
        column(whole, None, n_methods, None), column(whole, None, n_fields, None), column(whole, None, ends[c], ends[d], null=-1),
    ], schema=_SCHEMA)
