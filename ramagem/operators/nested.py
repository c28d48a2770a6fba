"""Nested JSON documents to linked flat rows by a vectorised structural index.

A batch of documents is one byte array. Bitmaps mark quotes that are not escaped, brackets and delimiters; a prefix sum
over the quotes tells which bytes are inside strings, another over the brackets the nesting depth. Ordering the
structural bytes by (depth, position) puts each container's own brackets, colons and commas side by side, which pairs
brackets, checks the grammar and yields the span of every key and value without walking any document.

Documents that are not complete JSON of two listings are unreadable and give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text indexed at a time; a longer document is indexed on its own.
CHUNK_BYTES = 2 << 20
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, QUOTE, BACKSLASH = b"{}[]:,\"\\"
_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[[OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True
_NUMBER = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_LITERALS = (b"true", b"false", b"null")
_BAD_ESCAPE = re.compile(rb'\\(?:[^"\\/bfnrtu]|u(?![0-9a-fA-F]{4}))')


class StructuralIndex:
    """Containers, members and spans of a run of documents.

    data: bytes of all documents; starts: the offset of each and the end. Afterwards `valid` tells which documents are
    JSON texts whose root is an array or object, and the arrays below describe those only.

    Containers c: doc, open, close (positions), is_object, parent (container or -1), key_token (token of its colon, -1
    outside objects), place (position among its siblings). Members of objects m: m_owner, key span m_key, value span
    m_value (string spans with quotes), m_child (container or -1).
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts
        docs = len(starts) - 1
        self.valid = starts[1:] > starts[:-1]
        self._strings()
        at = np.flatnonzero(_STRUCTURAL[data])
        before = self.quotes_before[at] - self.quotes_before[starts[:-1]][self._doc_of(at)]
        at = at[(before & 1) == 0]
        self._nest(at, docs)
        self._link()

    def _doc_of(self, at: np.ndarray) -> np.ndarray:
        # empty documents share their start with the next one, so the last of equal starts is wanted
        return np.searchsorted(self.starts, at, side="right") - 1

    def _strings(self) -> None:
        data = self.data
        is_quote = data == QUOTE
        slashes = np.flatnonzero(data == BACKSLASH)
        if len(slashes):
            first = np.ones(len(slashes), bool)
            first[1:] = (np.diff(slashes) != 1) | np.isin(slashes[1:], self.starts)
            run = np.flatnonzero(first)
            length = np.diff(np.append(run, len(slashes)))
            after = slashes[run] + length
            after = after[(length & 1 == 1) & (after < len(data))]
            is_quote[after[~np.isin(after, self.starts)]] = False
        self.quotes_before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(is_quote, out=self.quotes_before[1:])
        per_doc = self.quotes_before[self.starts[1:]] - self.quotes_before[self.starts[:-1]]
        self.valid &= (per_doc & 1) == 0
        quotes = np.flatnonzero(is_quote)
        control = np.flatnonzero(data < 32)
        if len(control):
            d = self._doc_of(control)
            inside = (self.quotes_before[control] - self.quotes_before[self.starts[d]]) & 1 == 1
            self.valid[d[inside]] = False
        if len(slashes):
            d = self._doc_of(slashes)
            outside = (self.quotes_before[slashes] - self.quotes_before[self.starts[d]]) & 1 == 0
            self.valid[d[outside]] = False
            whole = data.tobytes()
            for x in np.unique(d).tolist():  # escapes are rare enough to check document by document
                text = whole[self.starts[x] : self.starts[x + 1]].replace(rb"\\", b"")
                if _BAD_ESCAPE.search(text):
                    self.valid[x] = False
        self.quotes = quotes

    def _nest(self, at: np.ndarray, docs: int) -> None:
        char, doc = self.data[at], self._doc_of(at)
        opens = (char == OPEN_OBJECT) | (char == OPEN_ARRAY)
        closes = (char == CLOSE_OBJECT) | (char == CLOSE_ARRAY)
        total = np.concatenate(([0], np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))))
        first = np.searchsorted(doc, np.arange(docs), side="left")
        last = np.searchsorted(doc, np.arange(docs), side="right")
        base = total[first]
        level = total[1:] - base[doc] + closes
        self.valid &= (last > first) & (total[last] == base)
        self.valid[doc[level <= 0]] = False
        # nothing may stand before the root's opening or after its closing bracket, and there is one root
        roots = opens & (level == 1)
        self.valid &= np.bincount(doc[roots], minlength=docs) == 1
        for d in np.flatnonzero(self.valid).tolist():
            a, z = at[first[d]], at[last[d] - 1]
            if a > self.starts[d] and not _SPACE[self.data[self.starts[d] : a]].all():
                self.valid[d] = False
            if z + 1 < self.starts[d + 1] and not _SPACE[self.data[z + 1 : self.starts[d + 1]]].all():
                self.valid[d] = False
        keep = self.valid[doc]
        self.at, self.char, self.doc, self.level = at[keep], char[keep], doc[keep], level[keep]
        self.opens, self.closes = opens[keep], closes[keep]

    def _trim(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without white space at their ends."""
        a, z = a.copy(), z.copy()
        last = len(self.data) - 1
        more = np.flatnonzero((a < z) & _SPACE[self.data[np.minimum(a, last)]])
        while more.size:
            a[more] += 1
            more = more[(a[more] < z[more]) & _SPACE[self.data[np.minimum(a[more], last)]]]
        more = np.flatnonzero((a < z) & _SPACE[self.data[np.maximum(z - 1, 0)]])
        while more.size:
            z[more] -= 1
            more = more[(a[more] < z[more]) & _SPACE[self.data[np.maximum(z[more] - 1, 0)]]]
        return a, z

    def _link(self) -> None:
        order = np.lexsort((self.at, self.level)) if len(self.at) else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        container_sorted = np.cumsum(self.opens[order]) - 1
        container = np.empty(len(order), np.int64)
        container[order] = container_sorted
        open_token = order[self.opens[order]]
        close_token = order[self.closes[order]]
        ok = np.ones(len(self.at), bool)
        ok[close_token] = self.char[close_token] == self.char[open_token] + 2
        is_object = self.char[open_token] == OPEN_OBJECT
        # the token after each one in its own container, and whether a child container stands between
        nxt = np.full(len(order), -1, np.int64)
        nxt[order[:-1]] = order[1:]
        nxt[close_token] = -1
        t = np.flatnonzero(nxt >= 0)
        n = nxt[t]
        inner = n != t + 1
        a, z = self._trim(self.at[t] + 1, self.at[n])
        child = np.full(len(t), -1, np.int64)
        child[inner] = container[t[inner] + 1]
        good_child = np.zeros(len(t), bool)
        c = child[inner]
        good_child[inner] = (self.at[open_token[c]] == a[inner]) & (self.at[close_token[c]] + 1 == z[inner])
        empty = a >= z
        quotes = self.quotes_before[z] - self.quotes_before[a]
        safe = np.minimum(a, len(self.data) - 1)
        string = ~inner & ~empty & (self.data[safe] == QUOTE) & (self.data[np.maximum(z - 1, 0)] == QUOTE) & (quotes == 2) & (z - a >= 2)
        scalar = ~inner & ~empty & (quotes == 0)
        whole = self.data.tobytes()
        good: dict[bytes, bool] = {}
        for i, x, y in zip(*(v.tolist() for v in (np.flatnonzero(scalar), a[scalar], z[scalar]))):
            text = whole[x:y]
            fine = good.get(text)
            if fine is None:
                fine = good[text] = text in _LITERALS or _NUMBER.fullmatch(text) is not None
            if not fine:
                scalar[i] = False
        value = good_child | string | scalar
        now, then, in_object = self.char[t], self.char[n], is_object[container[t]]
        is_key = in_object & (then == COLON)
        is_value = in_object & (now == COLON)
        right = np.where(
            in_object,
            np.where(
                then == COLON,
                string & (now != COLON),
                np.where(now == COLON, value & (then != COLON), empty & ~inner & (now == OPEN_OBJECT) & (then == CLOSE_OBJECT)),
            ),
            (then != COLON) & (value | (empty & ~inner & (now == OPEN_ARRAY) & (then == CLOSE_ARRAY))),
        )
        ok[t] &= right
        self.valid[self.doc[~ok]] = False
        alive = self.valid[self.doc]

        self.c_doc, self.c_open, self.c_close = self.doc[open_token], self.at[open_token], self.at[close_token] + 1
        self.c_is_object, self.c_level = is_object, self.level[open_token]
        self.c_valid = alive[open_token]
        has_parent = self.level[open_token] > 1
        ahead = open_token - 1
        self.c_parent = np.where(has_parent, container[np.maximum(ahead, 0)], -1)
        self.c_colon = np.where(has_parent & (self.char[np.maximum(ahead, 0)] == COLON), ahead, -1)
        # commas before it among its siblings
        commas = np.cumsum(self.char[order] == COMMA)
        place = commas[rank[np.maximum(ahead, 0)]] - commas[rank[open_token[np.maximum(self.c_parent, 0)]]]
        self.c_place = np.where(has_parent, place, 0)
        # members: the gap before a colon is the key, the gap after it the value
        k, v = np.flatnonzero(is_key), np.flatnonzero(is_value)
        colon_of_key, colon_of_value = n[k], t[v]
        k, v = k[np.argsort(colon_of_key, kind="stable")], v[np.argsort(colon_of_value, kind="stable")]
        if len(k) != len(v):  # some document is broken; pair by colon
            both = np.intersect1d(n[k], t[v])
            k, v = k[np.isin(n[k], both)], v[np.isin(t[v], both)]
        self.m_colon = t[v]
        self.m_owner = container[t[v]]
        self.m_key = np.stack((a[k] + 1, z[k] - 1), 1)
        self.m_value = np.stack((a[v], z[v]), 1)
        self.m_child, self.m_string = child[v], string[v]
        self.m_valid = alive[t[v]]

    def key_codes(self, names: tuple[bytes, ...]) -> np.ndarray:
        """For every member the place of its key in names, else -1."""
        width = self.m_key[:, 1] - self.m_key[:, 0]
        code = np.full(len(width), -1, np.int16)
        for i, name in enumerate(names):
            at = np.flatnonzero((width == len(name)) & (code < 0))
            for j, byte in enumerate(name):
                at = at[self.data[self.m_key[at, 0] + j] == byte]
            code[at] = i
        return code


def _decode(text: bytes, a: int, z: int) -> str:
    """A string span, quotes included."""
    inner = text[a + 1 : z - 1]
    if b"\\" not in inner:
        return inner.decode("utf-8", "replace")
    return json.loads(text[a:z].decode("utf-8", "replace"), strict=False).encode("utf-8", "replace").decode()


def _scalar(text: bytes, a: int, z: int, is_string: bool) -> str | None:
    if is_string:
        return _decode(text, a, z)
    plain = text[a:z].decode()
    return None if plain == "null" else plain


def _bare(name: str | None) -> str | None:
    return (name.rpartition("_")[2] or None) if name else None


_KEYS = (b"kind", b"data", b"children", b"replies", b"id")
_KIND, _DATA, _CHILDREN, _REPLIES, _ID = range(5)
#: kind of a listing entry -> kind of the row
ENTRY_KINDS = {"t3": "post", "t1": "comment"}

OBJECT_SCHEMA = (
    "file_no bigint, obj int, parent_obj int, kind string, name string, place int, depth int, "
    "post_id string, id string, parent_id string, fields map<string,string>, lists map<string,string>"
)
LINK_SCHEMA = "file_no bigint, post_id string, id string, parent_id string"


def _last(index: StructuralIndex, member: np.ndarray, count: int) -> np.ndarray:
    """For each container the last of the given members (JSON keeps the last of repeated keys), else -1."""
    out = np.full(count, -1, np.int64)
    out[index.m_owner[member]] = member  # members are in order of position, the last assignment stays
    return out


class _Posts:
    """The listing structure over a structural index: which containers are entries, of what kind, under what."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        ix = self.ix = StructuralIndex(data, starts)
        self.text = data.tobytes()
        n = len(ix.c_open)
        code = ix.key_codes(_KEYS)
        kind_of, data_of, children_of, replies_of, self.id_of = (_last(ix, np.flatnonzero(code == i), n) for i in range(5))
        parent = ix.c_parent
        up = lambda c: np.where(c >= 0, parent[np.maximum(c, 0)], -1)

        def value_child(member_of: np.ndarray, c: np.ndarray) -> np.ndarray:
            m = np.where(c >= 0, member_of[np.maximum(c, 0)], -1)
            return np.where(m >= 0, ix.m_child[np.maximum(m, 0)], -1)

        every = np.arange(n)
        kind_is = self._kinds(kind_of, n)
        # an entry: object in the array `children` of the object `data` of a listing
        array = up(every)
        box = up(array)
        listing = up(box)
        listed = (ix.c_is_object) & (listing >= 0) & (value_child(children_of, box) == array) & (value_child(data_of, listing) == box)
        listed &= ~ix.c_is_object[np.maximum(array, 0)] & ix.c_valid
        above = up(listing)
        root = (listing >= 0) & (ix.c_level[np.maximum(listing, 0)] == 2) & ~ix.c_is_object[np.maximum(above, 0)]
        self.listing_no = np.where(root, ix.c_place[np.maximum(listing, 0)], -1)
        reply_to = np.where((listing >= 0) & (value_child(replies_of, above) == listing), up(above), -1)  # the entry whose data holds the replies
        reply_to = np.where((reply_to >= 0) & (value_child(data_of, reply_to) == above), reply_to, -1)
        # readable documents: an array of exactly two listings, the first with the post
        roots = np.flatnonzero((ix.c_level == 1) & ix.c_valid & ~ix.c_is_object)
        members = np.flatnonzero((ix.c_level == 2) & ix.c_valid & ix.c_is_object)
        docs = len(starts) - 1
        tops = np.bincount(ix.c_doc[members], minlength=docs)
        elements = np.bincount(ix.doc[(ix.level == 1) & (ix.char == COMMA)], minlength=docs) + 1
        listings = np.zeros(docs, np.int64)
        good = members[(kind_is[members] == "Listing") & (value_child(data_of, members) >= 0)]
        np.add.at(listings, ix.c_doc[good], 1)
        self.readable = np.zeros(docs, bool)
        self.readable[ix.c_doc[roots]] = True
        self.readable &= ix.valid & (tops == 2) & (elements == 2) & (listings == 2)
        entry = listed & self.readable[ix.c_doc]
        self.box_of = np.where(entry, value_child(data_of, every), -1)
        is_post = entry & (self.listing_no == 0) & (kind_is == "t3")
        comment = entry & (kind_is == "t1") & (self.listing_no == 1)
        reply = entry & (kind_is == "t1") & (reply_to >= 0)
        while True:  # one turn for each level of replies
            more = reply & ~comment & comment[np.maximum(reply_to, 0)]
            if not more.any():
                break
            comment |= more
        self.is_post, self.is_comment, self.entry, self.reply_to, self.kind_is, self.listing = is_post, comment, entry, reply_to, kind_is, listing
        self.box, self.array = box, array
        # the first post of each document
        self.post_of = np.full(docs, -1, np.int64)
        posts = np.flatnonzero(is_post)
        posts = posts[np.argsort(-ix.c_open[posts], kind="stable")]
        self.post_of[ix.c_doc[posts]] = posts

    def _kinds(self, kind_of: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, None, object)
        for c in np.flatnonzero(kind_of >= 0).tolist():
            m = kind_of[c]
            if self.ix.m_string[m]:
                a, z = self.ix.m_value[m].tolist()
                out[c] = self.text[a + 1 : z - 1].decode("utf-8", "replace")
        return out

    def entry_id(self, c: int) -> str | None:
        box = self.box_of[c]
        m = self.id_of[box] if box >= 0 else -1
        if m < 0 or self.ix.m_child[m] >= 0:
            return None
        a, z = self.ix.m_value[m].tolist()
        return _bare(_scalar(self.text, a, z, bool(self.ix.m_string[m])))

    def links(self) -> Iterator[tuple[int, str | None, str | None, str | None]]:
        """(document, post id, id, parent id) of every comment; the parent is the nearest enclosing comment with an id, else the post."""
        post_ids = {d: self.entry_id(int(c)) for d, c in enumerate(self.post_of) if c >= 0}
        ids: dict[int, str | None] = {}
        comments = np.flatnonzero(self.is_comment)
        comments = comments[np.argsort(self.ix.c_open[comments], kind="stable")]
        for c in comments.tolist():
            ids[c] = own = self.entry_id(c)
            d = int(self.ix.c_doc[c])
            over = int(self.reply_to[c])
            while over >= 0 and ids.get(over) is None:
                over = int(self.reply_to[over])
            yield d, post_ids.get(d), own, ids[over] if over >= 0 else post_ids.get(d)

    def objects(self, kinds: tuple[str, ...] | None = None, wanted: tuple[str, ...] | None = None) -> Iterator[tuple]:
        """A row for every object but the wrappers: listings, their data, and the data of entries (merged into the entry).

        kinds leaves out rows of other kinds, wanted members of other names, which then are not even decoded.
        """
        ix, text = self.ix, self.text
        live = ix.c_valid & self.readable[ix.c_doc]
        entries = np.flatnonzero(self.entry)
        skip = np.zeros(len(ix.c_open), bool)
        boxes = self.box_of[entries]
        owner_entry = np.full(len(ix.c_open), -1, np.int64)
        owner_entry[boxes[boxes >= 0]] = entries[boxes >= 0]
        skip[boxes[boxes >= 0]] = True
        skip[self.listing[entries]] = True
        skip[self.box[entries]] = True
        named_listing = np.flatnonzero(live & ix.c_is_object & (self.kind_is == "Listing"))
        skip[named_listing] = True
        in_listing = np.flatnonzero(live & ix.c_is_object & (ix.c_parent >= 0) & np.isin(ix.c_parent, named_listing))
        skip[in_listing] = True
        rows = np.flatnonzero(live & ix.c_is_object & ~skip)
        rows = rows[np.argsort(ix.c_open[rows], kind="stable")]
        is_row = np.zeros(len(ix.c_open), bool)
        is_row[rows] = True
        of_listing = np.zeros(len(ix.c_open), bool)  # arrays whose objects are entries
        of_listing[self.array[entries]] = True
        # members by owner
        use = np.flatnonzero(ix.m_valid & self.readable[ix.c_doc[ix.m_owner]])
        use = use[np.argsort(ix.m_owner[use], kind="stable")]
        low = np.searchsorted(ix.m_owner[use], np.arange(len(ix.c_open)), side="left")
        high = np.searchsorted(ix.m_owner[use], np.arange(len(ix.c_open)), side="right")
        colon_name = dict(zip(ix.m_colon[use].tolist(), use.tolist()))
        # numbers in order of text within each document
        row_doc = ix.c_doc[rows]
        number = np.full(len(ix.c_open), -1, np.int64)
        number[rows] = np.arange(len(rows)) - np.searchsorted(row_doc, row_doc) + 1
        # the row above each one: wrappers are passed over
        above_of = ix.c_parent[rows].copy()
        owner_entry = owner_entry.copy()
        while True:
            seek = np.flatnonzero((above_of >= 0) & ~is_row[np.maximum(above_of, 0)])
            if not len(seek):
                break
            c = above_of[seek]
            above_of[seek] = np.where(owner_entry[c] >= 0, owner_entry[c], ix.c_parent[c])
        code = None
        if wanted is not None:
            code = ix.key_codes(tuple(w.encode() for w in wanted)) >= 0
        post_ids = {d: self.entry_id(int(c)) for d, c in enumerate(self.post_of) if c >= 0}
        level: dict[int, int] = {}  # comments at or above it
        near: dict[int, str | None] = {}  # id of the nearest comment at or above, else of the post
        # only entries change what is above a row, so that rows of kinds not asked for are passed over
        if kinds is not None and set(kinds) <= set(ENTRY_KINDS.values()):
            some = self.entry[rows]
            if self.entry[above_of[some & (above_of >= 0)]].all():
                rows, above_of = rows[some], above_of[some]

        key_span, value_span, member_child, is_string = ix.m_key.tolist(), ix.m_value.tolist(), ix.m_child.tolist(), ix.m_string.tolist()
        keys_seen: dict[bytes, str] = {}

        def intern_key(raw: bytes) -> str:
            got = keys_seen.get(raw)
            if got is None:
                got = keys_seen[raw] = _decode(b'"' + raw + b'"', 0, len(raw) + 2)
            return got

        def name_of(c: int) -> str | None:
            while c >= 0 and ix.c_colon[c] < 0:
                c = int(ix.c_parent[c])
            if c < 0:
                return None
            a, z = ix.m_key[colon_name[int(ix.c_colon[c])]].tolist()
            return intern_key(text[a:z])

        for c, up in zip(rows.tolist(), above_of.tolist()):
            d = int(ix.c_doc[c])
            entry = bool(self.entry[c])
            word = (ENTRY_KINDS.get(self.kind_is[c], self.kind_is[c]) or "entry") if entry else "object"
            if word == "comment" and not self.is_comment[c] or word == "post" and not self.is_post[c]:
                word = "entry"
            own = self.entry_id(c) if entry else None
            above = near.get(up, post_ids.get(d))
            near[c] = own if word == "comment" and own is not None else above
            level[c] = level.get(up, 0) + (word == "comment")
            if kinds is not None and word not in kinds:
                continue
            fields, lists = {}, {}
            for holder in (c, int(self.box_of[c])) if entry else (c,):
                if holder < 0:
                    continue
                for m in use[low[holder] : high[holder]].tolist():
                    if code is not None and not code[m]:
                        continue
                    a, z = key_span[m]
                    key = intern_key(text[a:z])
                    va, vz = value_span[m]
                    child = member_child[m]
                    if child < 0:
                        fields[key] = _scalar(text, va, vz, is_string[m])
                    elif not ix.c_is_object[child] and not of_listing[child]:
                        lists[key] = text[va:vz].decode("utf-8", "replace")
            yield d, int(number[c]), int(number[up]) if up >= 0 else None, word, name_of(c), int(ix.c_place[c]), level[c], post_ids.get(d), own, above, fields, lists


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) of runs of rows of about CHUNK_BYTES; null texts count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def readable_rows(column: pa.Array) -> np.ndarray:
    """Which texts are complete JSON of two listings."""
    out = np.zeros(len(column), bool)
    for row, data, starts in _chunks(column):
        if len(data):
            out[row : row + len(starts) - 1] = _Posts(data, starts).readable
    return out


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string": pa.map_(pa.string(), pa.string())}
    fields = [x.strip().split(" ") for x in ddl.replace("map<string,string>", "map<string").split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def comment_links(files: DataFrame) -> DataFrame:
    """(file_no, post_id, id, parent_id) of each comment with an id in files (file_no, doc).

    Comments without id give no row; what they enclose names the next comment above that has one, else the post.
    Null, empty, cut-off and other texts give no rows. Ids are without prefix. Not distinct over files.
    """
    schema = _arrow_schema(LINK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("file_no")
            for row, data, starts in _chunks(batch.column("doc")):
                if len(data):
                    found = [(numbers[row + d].as_py(), p, i, up) for d, p, i, up in _Posts(data, starts).links() if i is not None]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return files.select("file_no", "doc").mapInArrow(run, LINK_SCHEMA)


def flat_objects(files: DataFrame, kinds: tuple[str, ...] | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each object in files (file_no, doc), naming the object that holds it: see OBJECT_SCHEMA.

    With kinds only objects of these kinds, with wanted only members of these names; obj and parent_obj stay the same.

    kind: post, comment, entry kinds of other names, or object. obj numbers the objects of a file in order of text,
    parent_obj is the number of the enclosing one (null at the top), depth the number of comments at or above. fields holds scalar members as text (the last of
    repeated keys), lists the arrays as JSON. Posts and comments have id; parent_id is the enclosing comment, else the post.
    """
    schema = _arrow_schema(OBJECT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("file_no")
            for row, data, starts in _chunks(batch.column("doc")):
                if not len(data):
                    continue
                found = [(numbers[row + d].as_py(), *rest[:-2], list(rest[-2].items()), list(rest[-1].items())) for d, *rest in _Posts(data, starts).objects(kinds, wanted)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return files.select("file_no", "doc").mapInArrow(run, OBJECT_SCHEMA)
