"""Operator 4: HTML extraction by union-free wrappers inferred for each host.

A page is a stream of tags and texts. Within a page, adjacent equal stretches become one
repeated group. The streams of a host's pages are then aligned one after another with
the wrapper so far: what only one side has becomes optional, what one side repeats
becomes a repeated group, and texts become slots. There are no alternatives, so the
result is a union-free regular expression. A slot whose text is the same on all pages
belongs to the template; the others are fields, and a page's fields are extracted by
aligning its stream with its host's wrapper.

Streams are aligned by their longest common subsequence, kept in the bits of long integers,
so that an alignment takes a machine word's operation for 64 pairs of tokens.

Pages of one structure align alike, so hosts fold distinct structures, not pages:
tasks first add up their own. A host's structures are folded in parts of bounded size,
then the parts in parts, until one is left.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, maybe_broadcast
from ._frames import MAX_SAFE_ROWS, batched, table, tidy, tidy_group

TEXT = "#"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PART = 128
"""Structures, or wrappers of parts, of a host that a task folds into one, on average."""
WRAPPER_BYTES = 64 << 20
"""Bytes of wrappers that may be broadcast; checked by a sum over all hosts."""
LCS_BITS = 1 << 28
"""Bits that an alignment holds at once; longer streams are halved first."""
CACHE = 4096
"""Wrappers that a task keeps parsed. Speed only."""
KEPT_TOKENS = 400_000
"""Tokens of streams whose folds a task keeps."""

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<!?/?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)", re.DOTALL)
_CLASS = re.compile(r"\s(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text) of a page: tags have no text, texts the key ``#``. Comments, scripts and blank texts are left out."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(page):
        raw = m.group()
        if raw.startswith("<!") or m.group(1):
            continue
        tag = _TAG.match(raw) if raw[0] == "<" and len(raw) > 1 else None
        if tag:
            marks = "" if tag.group(1) else "".join("." + next(x for x in c if x).strip() for c in _CLASS.findall(raw) if any(c))
            out.append((tag.group(1) + tag.group(2).lower() + marks, ""))
        elif raw.strip():
            if out and out[-1][0] == TEXT:
                out[-1] = (TEXT, out[-1][1] + raw)
            else:
                out.append((TEXT, raw))
    return out


def fold_repeats(keys: list[str]) -> list:
    """A stream with adjacent equal stretches as repeated groups.

    Items are ``[key, positions]`` or ``["*", body, count]``; the shortest period wins, from the left,
    and what is left is folded again, so groups nest. Periods of any length are looked for, up to half of the stream.
    """
    items: list = [[k, [i]] for i, k in enumerate(keys)]
    names = list(keys)
    while True:
        code: dict[str, int] = {}
        ids = np.array([code.setdefault(n, len(code)) for n in names], np.int64)
        alone = np.array([n[0] != "*" and n != TEXT for n in names], bool)
        for period in _periods(ids):
            same = ids[:-period] == ids[period:]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            # one token by itself is no group unless it is a text or a group
            runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= period and (period > 1 or not alone[a])]
            if not runs:
                continue
            done, at, new_items, new_names = 0, 0, [], []
            for a, b in runs:
                # a run that begins within the group before may be long enough after it
                a = max(a, done)
                if b - a < period or period == 1 and alone[a]:
                    continue
                count = (b - a) // period + 1
                new_items += items[at:a]
                new_names += names[at:a]
                body = [_zip_items([items[a + r * period + k] for r in range(count)]) for k in range(period)]
                new_items.append(["*", body, count])
                new_names.append("*(" + " ".join(names[a : a + period]) + ")")
                at = done = a + count * period
            items, names = new_items + items[at:], new_names + names[at:]
            break
        else:
            return items


def _periods(ids: np.ndarray):
    """Periods at which equal stretches may be adjacent, in order: every one at which any are.

    Stretches of 4 tokens or more are named by doubling, so that equal names mean equal
    stretches of 4, 8, 16 ... tokens. Where those of a period between a length and twice
    it are adjacent, two of the length are as far apart; none lies between them, since
    that would be adjacent stretches of a shorter period, which come first.
    """
    n = len(ids)
    yield from range(1, min(4, n // 2 + 1))
    size, name = 1, ids
    while size * 2 <= n // 2:
        pair = name[:-size] * (int(name.max()) + 1) + name[size:]
        size, name = size * 2, np.unique(pair, return_inverse=True)[1]
        if size >= 4:
            order = np.argsort(name, kind="stable")
            gap = np.diff(order)[name[order][1:] == name[order][:-1]]
            yield from np.unique(gap[(gap >= size) & (gap < 2 * size) & (gap <= n // 2)]).tolist()


def _zip_items(copies: list) -> list:
    first = copies[0]
    if first[0] == "*":
        return ["*", [_zip_items([c[1][k] for c in copies]) for k in range(len(first[1]))], sum(c[2] for c in copies)]
    return [first[0], [p for c in copies for p in c[1]]]


def shape(items: list) -> list:
    """The structure of folded items, without positions: keys, and ``["*", shape]`` for groups."""
    return [["*", shape(x[1])] if x[0] == "*" else x[0] for x in items]


def _name(item) -> str:
    return item if isinstance(item, str) else "*" + _name(item[1][0]) if item[1] else "*"


# A wrapper is a list of nodes [key, optional group or 0, slot or body]: a tag has None, a text its constant
# ("" unknown yet, null a field), and a repeated group (key "*") its wrapper.


def wrap(struct: list, constants: list | None = None) -> list:
    it = iter(constants or [])

    def build(part: list, deep: bool) -> list:
        return [["*", 0, build(x[1], True)] if not isinstance(x, str) else [x, 0, (None if deep else next(it, None)) if x == TEXT else None] for x in part]

    return build(struct, False)


def _label(node: list) -> str:
    return "*" + (_label(node[2][0]) if node[2] else "") if node[0] == "*" else node[0]


def _labels(nodes: list) -> list[str]:
    """What nodes are matched by: texts also by the element they stand in, closing tags by the tag they close."""
    out, open_ = [], []
    for node in nodes:
        key = _label(node)
        if key[0] == "/":
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].split(".", 1)[0] == key[1:]), None)
            if at is not None:
                key = "/" + open_[at]
                del open_[at:]
        elif key == TEXT:
            key += open_[-1] if open_ else ""
        elif key[0] != "*" and key.split(".", 1)[0] not in VOID:
            open_.append(key)
        out.append(key)
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of several, that which takes up places of ``b`` the latest."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner = _common(a[low : len(a) - high], b[low : len(b) - high])
    return [(k, k) for k in range(low)] + [(low + i, low + j) for i, j in inner] + [(len(a) - high + k, len(b) - high + k) for k in range(high)]


def _rows(a: list, b: list):
    """For each prefix of ``b`` the integer whose bit ``i`` is 0 where its common subsequence with ``a`` grows at place ``i``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > LCS_BITS and len(b) > 1:
        # halves of b, split where the subsequences of both add up to the most
        half = len(b) // 2
        *_, v = _rows(a, b[:half])
        *_, w = _rows(a[::-1], b[half:][::-1])
        grown = [np.concatenate(([0], np.cumsum(1 - np.unpackbits(np.frombuffer(x.to_bytes(len(a) // 8 + 1, "little"), np.uint8), count=len(a), bitorder="little").astype(np.int64)))) for x in (v, w)]
        cut = int((grown[0] + grown[1][::-1]).argmax())
        return _common(a[:cut], b[:half]) + [(cut + i, half + j) for i, j in _common(a[cut:], b[half:])]
    rows = list(_rows(a, b))
    out = []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            # place i adds nothing: the nearest one below that does
            below = ~rows[j] & (1 << i) - 1
            i = below.bit_length() - 1
        elif j and not rows[j - 1] >> i & 1:
            # it did already without b[j]
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def align(left: list, right: list) -> list[tuple[int | None, int | None]]:
    """Pairs of indexes of two wrappers in order; None where a side has nothing.

    Groups match by how they begin. A stretch that stands where the other side has a
    group with the same body is matched to that group.
    """
    out: list[tuple[int | None, int | None]] = []
    x = y = 0
    for i, j in [*common(_labels(left), _labels(right)), (len(left), len(right))]:
        while x < i and y < j:
            if left[x][0] == "*" and _begins(left[x][2], right[y:j]):
                n = len(left[x][2])
                out += [(x, y + t) for t in range(n)]
                x, y = x + 1, y + n
            elif right[y][0] == "*" and _begins(right[y][2], left[x:i]):
                n = len(right[y][2])
                out += [(x + t, y) for t in range(n)]
                x, y = x + n, y + 1
            else:
                break
        out += [(t, None) for t in range(x, i)]
        out += [(None, t) for t in range(y, j)]
        if i < len(left):
            out.append((i, j))
        x, y = i + 1, j + 1
    return out


def _begins(body: list, nodes: list) -> bool:
    return len(body) <= len(nodes) and all(_label(p) == _label(q) for p, q in zip(body, nodes, strict=False))


def merge(left: list, right: list, groups: list[int]) -> list:
    """The wrapper of what either wrapper describes. ``groups``: a counter for optional groups."""
    out: list = []
    renamed: dict[tuple, int] = {}

    def group(*key) -> int:
        if key not in renamed:
            groups[0] += 1
            renamed[key] = groups[0]
        return renamed[key]

    run, last = 0, ""
    at_l: int | None = None
    at_r: int | None = None
    for i, j in align(left, right):
        side = "l" if j is None else "r" if i is None else "b"
        if side != last:
            run, last = run + 1, side
        if side != "b":
            node = left[i] if side == "l" else right[j]
            out.append([node[0], group(side, run, node[1]), node[2]])
            continue
        p, q = left[i], right[j]
        if p[0] == "*" and q[0] == "*":
            body = merge(p[2], q[2], groups)
        elif p[0] == "*" or q[0] == "*":
            # a single stretch beside a group: once for each of its nodes, kept as the group
            if (p[0] == "*" and i == at_l) or (q[0] == "*" and j == at_r):
                at_l, at_r = i, j
                continue
            at_l, at_r = i, j
            star = p if p[0] == "*" else q
            out.append(["*", group("b", p[1], q[1]) if p[1] or q[1] else 0, star[2]])
            continue
        else:
            body = p[2] if p[2] == q[2] else None
        at_l, at_r = i, j
        out.append([p[0], group("b", p[1], q[1]) if p[1] or q[1] else 0, body])
    return out


def pattern(wrapper: list) -> str:
    """The wrapper as a union-free regular expression over tags: ``( )?`` optional, ``( )+`` repeated, ``#`` a field."""
    out, at = [], 0
    while at < len(wrapper):
        g = wrapper[at][1]
        end = at + 1
        while g and end < len(wrapper) and wrapper[end][1] == g:
            end += 1
        part = " ".join("(" + pattern(n[2]) + ")+" if n[0] == "*" else (TEXT if n[2] is None else json.dumps(n[2], ensure_ascii=False)) if n[0] == TEXT else f"<{n[0]}>" for n in wrapper[at:end])
        out.append(f"({part})?" if g else part)
        at = end
    return " ".join(out)


def _slots(items: list, wrapper: list, out: dict[int, int], counter: list[int], place: bool) -> None:
    """Number the wrapper's slots in order, and give each text position of ``items`` its slot."""
    numbers: list = []
    for node in wrapper:
        if node[0] == "*":
            numbers.append(counter[0])
            _slots([], node[2], {}, counter, False)
        elif node[0] == TEXT:
            numbers.append(counter[0])
            counter[0] += 1
        else:
            numbers.append(None)
    if not place:
        return
    mine = wrap(shape(items))
    used: dict[int, int] = {}
    for i, j in align(wrapper, mine):
        if i is None or j is None:
            continue
        node, item = wrapper[i], items[j]
        if node[0] == "*":
            sub = [numbers[i]]
            if item[0] == "*":
                _slots(item[1], node[2], out, sub, True)
            elif item[0] == TEXT:
                inner = [n for n in node[2]]
                k = used.get(i, 0)
                flat = [numbers[i] + t for t, n in enumerate([x for x in inner if x[0] == TEXT])]
                if k < len(flat):
                    for p in item[1]:
                        out[p] = flat[k]
                    used[i] = k + 1
        elif node[0] == TEXT and item[0] == TEXT and node[2] is None:
            for p in item[1]:
                out[p] = numbers[i]


def slots_of(items: list, wrapper: list) -> dict[int, int]:
    """Text position -> slot, for the texts of a page that fill fields of the wrapper."""
    out: dict[int, int] = {}
    _slots(items, wrapper, out, [0], True)
    return out


class Kept:
    """Results by key, kept until they are too many: pages of a site have few different streams. Speed only."""

    def __init__(self, make):
        self.make, self.held, self.size = make, {}, 0

    def of(self, key: tuple, weight: int, *args):
        if key not in self.held:
            if self.size > KEPT_TOKENS:
                self.held, self.size = {}, 0
            self.held[key] = self.make(*args)
            self.size += weight + 16
        return self.held[key]


def _folded(keys: list[str]) -> tuple[list, str]:
    items = fold_repeats(keys)
    return items, json.dumps(shape(items), ensure_ascii=False, separators=(",", ":"))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _structures(batches):
    """(host, structure, n, constants): the distinct structures of a task's pages."""
    found: OrderedDict[tuple[str, str], list] = OrderedDict()
    folds = Kept(_folded)

    def rows():
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([json.dumps(found[k][1], ensure_ascii=False) for k in keys], pa.string())], ["host", "structure", "n", "constants"])
        found.clear()

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = page.as_py()
            if not page:
                continue
            stream = tokens(page)
            if not stream:
                continue
            keys = [k for k, _ in stream]
            items, structure = folds.of(tuple(keys), len(keys), keys)
            texts = [" ".join(stream[x[1][0]][1].split()) for x in items if x[0] == TEXT]
            key = (host, structure)
            if key in found:
                old = found[key]
                old[0] += 1
                old[1] = [a if a == b else None for a, b in zip(old[1], texts, strict=True)]
            else:
                found[key] = [1, texts]
            if len(found) >= 20_000:
                yield from rows()
    if found:
        yield from rows()


def _fold(structures: bool):
    def run(rows: pa.Table) -> pa.Table:
        host = rows.column("host")[0].as_py()
        got = sorted(zip(rows.column("n").to_pylist(), rows.column("structure").to_pylist(), rows.column("constants").to_pylist(), strict=True), key=lambda r: (-r[0], r[1], r[2] or ""))
        wrapper, groups, total = None, [0], 0
        for n, text, constants in got:
            part = wrap(json.loads(text), json.loads(constants)) if structures else json.loads(text)
            if not structures:
                part = _shift(part, groups)
            wrapper = part if wrapper is None else merge(wrapper, part, groups)
            total += n
        return pa.table({"host": [host], "structure": [json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))], "n": pa.array([total], pa.int64()), "constants": pa.array([None], pa.string())})

    return run


def _shift(wrapper: list, groups: list[int]) -> list:
    seen: dict[int, int] = {}

    def walk(part: list) -> list:
        out = []
        for key, g, body in part:
            if g and g not in seen:
                groups[0] += 1
                seen[g] = groups[0]
            out.append([key, seen[g] if g else 0, walk(body) if key == "*" else body])
        return out

    return walk(wrapper)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages, pattern): one wrapper for each host with a page of any tokens.

    A null or hostless url is the host ``""``. Null and empty pages do not count; repeated
    pages do. Structures are folded the most frequent first, then by their text, so the
    result does not depend on the order of rows.
    """
    schema = "host string, structure string, n bigint, constants string"
    picked = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.make_valid_utf8(F.col(f"`{html_col}`").cast("string")).alias("html"))
    found = picked.mapInArrow(tidy(_structures), schema)
    # equal structures of several tasks are one, so that their number and not the tasks' decides the order
    found = found.groupBy("host", "structure").agg(F.sum("n").alias("n"), F.collect_list("constants").alias("all"))

    def constant(batch: pa.RecordBatch):
        out = []
        for lists in batch.column(3).to_pylist():
            parts = [json.loads(x) for x in lists]
            out.append(json.dumps([v[0] if all(x == v[0] for x in v) else None for v in zip(*parts, strict=True)], ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["host", "structure", "n", "constants"])

    now = materialize(found.mapInArrow(batched(constant), schema), "wrapper-structures")
    structures = True
    while True:
        counts = now.groupBy("host").agg(F.ceil(F.count("*") / PART).alias("parts"))
        many = materialize(counts.where("parts > 1"), "wrapper-parts")
        n_many = many.count()
        if not n_many:
            whole = now.groupBy("host").applyInArrow(tidy_group(_fold(structures)), schema)
            break
        split = now.join(maybe_broadcast(many, n_many, MAX_SAFE_ROWS // 10), "host", "left").withColumn("part", F.pmod(F.xxhash64("structure"), F.coalesce("parts", F.lit(1))))
        now = materialize(split.select("host", "structure", "n", "constants", "part").groupBy("host", "part").applyInArrow(tidy_group(_fold(structures)), schema), "wrapper-folded")
        structures = False

    def show(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pattern(json.loads(w)) for w in batch.column(1).to_pylist()], pa.string())], ["host", "wrapper", "pages", "pattern"])

    return whole.select("host", F.col("structure").alias("wrapper"), F.col("n").alias("pages")).mapInArrow(batched(show), "host string, wrapper string, pages bigint, pattern string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, template_pages, fields, content): one row for each input row.

    ``fields``: (slot, text) in page order, texts with entities resolved and white space
    collapsed; slots are numbered within a host's wrapper. A text that the wrapper can't
    place has slot -1; template texts are left out. ``content`` joins the fields by line
    breaks. A null page has null fields and content, an empty one none and an empty
    content. Repeated rows are extracted alike, a null id stays null, other columns are
    not read. A host of one page has a wrapper without fields to tell from template: then
    every text is a field. Pages and wrappers of any length are aligned whole. Wrappers
    are broadcast if all together they have ``WRAPPER_BYTES`` or less.
    """
    wrappers = materialize(infer(pages, url_col, html_col).select("host", "wrapper", F.col("pages").alias("template_pages")), "wrappers")
    held = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + F.lit(64)).alias("b")).first()["b"] or 0
    side = maybe_broadcast(wrappers, held, WRAPPER_BYTES)
    picked = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), _host(F.col(f"`{url_col}`")).alias("host"), F.make_valid_utf8(F.col(f"`{html_col}`").cast("string")).alias("html"))
    joined = picked.join(side, "host", "left").select("page_id", "host", F.coalesce("template_pages", F.lit(0)).cast("bigint").alias("template_pages"), "html", "wrapper")

    def run(batches):
        known: dict[str, list] = {}
        folds = Kept(fold_repeats)
        places = Kept(lambda keys, wrapper: slots_of(folds.of(keys, len(keys), list(keys)), wrapper))
        for batch in batches:
            fields, content = [], []
            hosts, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, page in enumerate(batch.column(3)):
                page = page.as_py()
                if page is None:
                    fields.append(None)
                    content.append(None)
                    continue
                stream = tokens(page)
                got = []
                if stream:
                    keys = tuple(k for k, _ in stream)
                    if hosts[i] not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known[hosts[i]] = json.loads(batch.column(4)[i].as_py())
                    wrapper = known[hosts[i]]
                    slots = places.of((hosts[i], keys), len(keys), keys, wrapper)
                    constants = {n[2] for n in wrapper if n[0] == TEXT and n[2] is not None} if sizes[i] > 1 else set()
                    for at, (kind, text) in enumerate(stream):
                        if kind == TEXT:
                            plain = " ".join(text.split())
                            if at in slots or plain not in constants:
                                got.append({"slot": slots.get(at, -1), "text": " ".join(entities.unescape(plain).split())})
                fields.append(got)
                content.append("\n".join(f["text"] for f in got))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fields, pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))), pa.array(content, pa.string())], ["page_id", "host", "template_pages", "fields", "content"])

    return joined.mapInArrow(tidy(run), "page_id bigint, host string, template_pages bigint, fields array<struct<slot:int,text:string>>, content string")


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
