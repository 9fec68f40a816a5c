"""Main text of web pages with a suffix array per host.

Markup gives blocks and leaves out what it names as menu, footer, advert, comment and the like.
Where article or main elements hold at least half of the other words, a page is framed by them,
else open. The token streams of a host's pages are joined and their suffixes sorted as far as
``RUN`` tokens, which tells every substring of at least that many that is repeated; what
repeated substrings cover is boilerplate and leaves the text, unique runs stay. In open pages
those count that ``LEAST_PAGES`` distinct pages have; within articles those that half of the
host's distinct framed pages have, as an article may quote or copy another. Hosts with many
pages are cut into shards by a hash of the content; numbers of pages are summed over shards,
so runs are judged by the whole host: a run of half its pages is one of half a shard's in some shard.
"""

from __future__ import annotations

import html as htmllib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm._common import lean, small_enough, table
from gridloom.llm.omh_dedup import _P, _mix, word_hashes

RUN, SHARD_PAGES, SHARD_BYTES = 8, 256, 32_000_000
#: A run is boilerplate if at least so many distinct pages of the host have it, open or framed ones.
LEAST_PAGES, LEAST_FRAMED = 3, 5
BROADCAST_HOSTS, BROADCAST_KEYS = 100_000, 200_000

_DROP = set("nav footer aside form script style noscript template iframe svg button select textarea menu dialog head title object canvas audio video".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th thead tbody tfoot caption section article main blockquote pre figure figcaption body html address hr details summary center header footer nav aside form".split())
#: Elements that may end without an end tag, and the start tags that end them.
_IMPLIED = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}}
_NESTS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": set()}
#: Headings and whole parts of a page aren't left out for their class.
_KEPT = set("h1 h2 h3 h4 h5 h6 body html main article".split())
_NAMED = r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|sidebar|footer|masthead|cookie\w*|notice|consent|gdpr|comments?|disqus|share|sharing|social|related|recommend\w*|breadcrumb\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|toolbar)(?:$|[\s_-])"
_MARKED = re.compile(_NAMED, re.I)
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>")
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog)", re.I)


def _left_out(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is no part of the text by its name, its class or its role; an id tells
    that of plain boxes only. The header of an article holds its title."""
    if name in _DROP or (name == "header" and not inside):
        return True
    if not rest or name in _KEPT or name == "header":
        return False
    names = [(k.lower(), x.strip("\"'")) for k, x in _NAMES.findall(rest)]
    return any(_MARKED.search(x) for k, x in names if k != "id" or name in ("div", "ul", "ol")) or bool(_HIDDEN.search(rest))


def blocks(page: str) -> tuple[bool, list[str]]:
    """Text blocks of a page in order, and whether they are those of its article and main elements."""
    page = _RAW.sub(" ", page)
    out: list[tuple[bool, str]] = []
    part: list[str] = []
    drop, inner, main, at = "", [], 0, 0

    def end():
        text = " ".join(htmllib.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append((main > 0, text))

    for m in _TAG.finditer(page):
        if not drop:
            part.append(page[at : m.start()])
        at = m.end()
        closing, name, rest = m[1], m[2].lower(), m[3]
        if drop:
            if not closing:
                over = drop in _IMPLIED and name in _IMPLIED[drop] and not _NESTS[drop] & set(inner)
                if not over:
                    if name not in _VOID and not rest.endswith("/"):
                        inner.append(name)
                    continue
            elif name in inner:
                while inner.pop() != name:
                    pass
                continue
            elif name == drop:
                drop = ""
                continue
            elif drop not in _IMPLIED and name not in ("article", "main", "body", "html"):
                continue  # ends nothing that is open
            drop = ""  # its end tag was left out
        if closing:
            if name in _BLOCK:
                end()
            if name in ("article", "main"):
                main = max(0, main - 1)
            continue
        if name in _VOID or rest.endswith("/"):
            part.append(" ")
            if name == "hr":
                end()
        elif _left_out(name, rest, main > 0):
            end()
            drop, inner = name, []
        else:
            if name in _BLOCK:
                end()
            if name in ("article", "main"):
                main += 1
    if not drop:
        part.append(page[at:])
    end()
    n = [sum(len(t.split()) for m, t in out if m == k) for k in (False, True)]
    framed = n[1] > 0 and n[1] >= n[0]
    return framed, [t for m, t in out if m or not framed]


def spreads(pages: list[list[list[str]]], run: int = RUN) -> list[np.ndarray]:
    """For each page, at each of its tokens, how many distinct pages have the run that starts there."""
    ids: dict[str, int] = {}
    stream, owner = [], []
    for k, blocks_ in enumerate(pages):
        for b in blocks_:
            stream += [ids.setdefault(t, len(ids) + 1) for t in b]
            owner += [k] * len(b)
        stream.append(-k - 1)  # a separator of its own: no run crosses pages
        owner.append(k)
    rank = np.unique(np.array(stream, np.int64), return_inverse=True)[1].astype(np.int64)
    owner_of = np.array(owner)
    n, width = len(rank), 1
    while width < run:  # suffixes by their first 2, 4, 8 tokens
        ahead = np.full(n, -1, np.int64)
        step = min(width, run - width)
        ahead[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    pair = np.unique(rank * len(pages) + owner_of)
    spread = np.bincount(pair // len(pages), minlength=rank.max() + 1)[rank]
    cuts = np.flatnonzero(np.array(stream) < 0)
    return [spread[(cuts[k - 1] + 1 if k else 0) : cuts[k]] for k in range(len(pages))]


def _within(starts: np.ndarray, run: int) -> np.ndarray:
    """Tokens that lie in a run that starts at one of the marked tokens."""
    edge = np.zeros(len(starts) + run + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + run] -= 1
    return np.cumsum(edge)[: len(starts)] > 0


def _unique(block: list[str], hit: np.ndarray) -> list[str]:
    """Tokens that stay: none of a block that is covered whole; of others all but covered
    stretches of ``RUN`` tokens or more, as runs reach a few words into the next block by chance."""
    if hit.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    gone = np.zeros(len(block), bool)
    for lo, hi in zip(edges[::2], edges[1::2]):
        gone[lo:hi] = hi - lo >= RUN
    return [t for t, g in zip(block, gone) if not g]


def covered(pages: list[list[list[str]]], least: int, run: int = RUN) -> list[np.ndarray]:
    """For each page whether each of its tokens lies in a run that ``least`` distinct pages have."""
    return [_within(x >= least, run) for x in spreads(pages, run)]


def run_keys(page: list[list[str]], run: int = RUN) -> np.ndarray:
    """64-bit key of the run that starts at each token from which there are ``run``; alike in all shards."""
    w = word_hashes(" ".join(t for b in page for t in b).encode("utf-8", "replace"))
    h = np.zeros(max(0, len(w) - run + 1), np.uint64)
    for j in range(run if len(h) else 0):
        h = _mix(h * _P + w[j : j + len(h)])
    return h.view(np.int64) & ~1  # without the last bit, which tells kinds of keys apart


def _distinct(all_blocks: list[list[str]]) -> tuple[list[list[list[str]]], list[int]]:
    """Tokens of the distinct pages, and which of them each page is: copies of a page are one."""
    at: dict[tuple, int] = {}
    which = [at.setdefault(tuple(bs), len(at)) for bs in all_blocks]
    return [[b.split(" ") for b in bs] for bs in at], which


def shard_runs(pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of distinct pages, sorted, and how many of the pages have each."""
    found = [(k, n[: len(k)]) for k, n in ((run_keys(p), x) for p, x in zip(pages, spreads(pages)))] if pages else []
    keys, first = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in found]]), return_index=True)
    return keys, np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])[first]


def clean(page: list[list[str]], repeated: np.ndarray) -> str:
    """Text of a page without what runs cover whose keys are ``repeated`` (sorted)."""
    keys, hit = run_keys(page), np.zeros(sum(map(len, page)), bool)
    if len(repeated) and len(keys):
        hit[: len(keys)] = repeated[np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)] == keys
        hit = _within(hit, RUN)
    kept, at = [], 0
    for b in page:
        own = _unique(b, hit[at : at + len(b)]) if len(repeated) else b
        at += len(b)
        if own:
            kept.append(" ".join(own))
    return "\n\n".join(kept)


def _pack(framed: bool, found: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(("1" if framed else "0").encode() + "\x1f".join(found).encode("utf-8", "replace"))


def _unpack(raw: bytes) -> tuple[bool, list[str]]:
    text = zstandard.ZstdDecompressor().decompress(raw).decode()
    return text[0] == "1", text[1:].split("\x1f") if len(text) > 1 else []  # a block has no such mark: it is white space


_SHARD = "host string, shard int, page_ids array<{id}>, urls array<string>, framed array<boolean>, blocks array<array<string>>, n_framed long, open_keys array<long>, open_n array<long>, wide_keys array<long>"


def _gathered(id_kind: pa.DataType):
    """A row for a shard: its pages, the runs of its open pages with the number of pages that
    have each, and the runs that at least half of its framed pages have."""

    def gather(t):
        pages = [_unpack(x) for x in t.column("packed").to_pylist()]
        (open_, _), (framed, _) = (_distinct([b for f, b in pages if f == k]) for k in (False, True))
        open_keys, open_n = shard_runs(open_)
        keys, n = shard_runs(framed)
        row = {"page_ids": t.column("page_id").to_pylist(), "urls": t.column("url").to_pylist(), "framed": [f for f, _ in pages], "blocks": [b for _, b in pages]}
        row |= {"n_framed": len(framed), "open_keys": open_keys, "open_n": open_n, "wide_keys": keys[2 * n >= len(framed)] if len(framed) > 1 else keys[:0]}
        kinds = {"page_ids": pa.list_(id_kind), "urls": pa.list_(pa.string()), "framed": pa.list_(pa.bool_()), "blocks": pa.list_(pa.list_(pa.string())), "n_framed": pa.int64()}
        cols = {c: pa.array([v], kinds.get(c, pa.list_(pa.int64()))) for c, v in row.items()}
        return pa.table({"host": t.column("host").slice(0, 1), "shard": t.column("shard").slice(0, 1)} | cols)

    return gather


def _per_host(shards: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``shards`` with the sorted ``keys`` of theirs as ``found``."""
    few = small_enough(keys, BROADCAST_KEYS)
    lists = keys.groupBy(*by).agg(F.sort_array(F.collect_set("key")).alias("found"))
    joined = shards.join(F.broadcast(lists) if few else lists, by, "left")
    return joined.withColumn("found", F.coalesce("found", F.array().cast("array<long>")))


def _wide(shards: DataFrame, candidates: DataFrame) -> DataFrame:
    """``host, shard, key`` of candidate runs that half the framed pages of a host have, wherever they occur."""

    def run(batches):
        for b in batches:
            rows = []
            for host, shard, framed, blocks_, found in zip(*(b.column(c).to_pylist() for c in ("host", "shard", "framed", "blocks", "found"))):
                pages, _ = _distinct([x for f, x in zip(framed, blocks_) if f]) if found else ([], [])
                keys = np.concatenate([np.zeros(0, np.int64), *[np.intersect1d(run_keys(p), np.array(found, np.int64)) for p in pages]])
                rows += [(host, shard, k, n) for k, n in zip(*(x.tolist() for x in np.unique(keys, return_counts=True)))]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "shard", "key", "n"])

    slim = _per_host(shards.select("host", "shard", "framed", "blocks"), candidates, ["host"])
    seen = table(slim.mapInArrow(lean(run), "host string, shard int, key long, n long"), "wide-runs")
    all_pages = shards.groupBy("host").agg(F.sum("n_framed").alias("pages"))
    over = seen.groupBy("host", "key").agg(F.sum("n").alias("n")).join(all_pages, "host").where((F.col("n") >= LEAST_FRAMED) & (2 * F.col("n") >= F.col("pages")))
    return seen.select("host", "shard", "key").join(over.select("host", "key"), ["host", "key"])


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null or empty pages have an empty text, and so have pages of which all is boilerplate. Runs
    go that ``LEAST_PAGES`` distinct pages of a host without article have in common, at any size
    of the host and also where copies of a text are what repeats, and runs that half of a
    host's distinct pages with article, ``LEAST_FRAMED`` or more, have in it. Equal pages count
    as one. Null urls form a host of their own; repeated rows are pages each; an empty table
    gives an empty table; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    need = F.greatest(F.ceil(F.count("*") / shard_pages), F.ceil(F.sum(F.octet_length("html")) / shard_bytes)).cast("int")
    hosts = slim.groupBy("host").agg(need.alias("shards"))
    hosts = F.broadcast(hosts) if small_enough(hosts, BROADCAST_HOSTS) else hosts

    def parse(batches):
        for b in batches:
            packed = [_pack(*blocks(x.as_py())) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])

    parsed = slim.mapInArrow(lean(parse), f"page_id {kinds['page_id']}, url string, host string, packed binary")
    # by content: copies of a page meet in one shard, where they count once
    placed = parsed.join(hosts, "host").withColumn("shard", F.pmod(F.xxhash64("packed"), F.col("shards")).cast("int")).drop("shards")
    id_kind = to_arrow_type(pages.schema["page_id"].dataType)
    shards = table(placed.groupBy("host", "shard").applyInArrow(_gathered(id_kind), _SHARD.format(id=kinds["page_id"])), "host-shards")

    runs = shards.select("host", "shard", F.explode(F.arrays_zip("open_keys", "open_n")).alias("x")).select("host", "shard", F.col("x.open_keys").alias("key"), F.col("x.open_n").alias("n"))
    often = runs.groupBy("host", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "key")
    repeated = runs.select("host", "shard", "key").join(often, ["host", "key"])
    candidates = shards.select("host", F.explode("wide_keys").alias("key")).distinct()
    both = repeated.unionByName(_wide(shards, candidates).withColumn("key", F.col("key").bitwiseOR(F.lit(1))))

    def texts(batches):
        for b in batches:
            for ids, urls, framed, blocks_, found in zip(*(b.column(c).to_pylist() for c in ("page_ids", "urls", "framed", "blocks", "found"))):
                found = np.array(found, np.int64)
                goes = {k: np.sort(found[found & 1 == k] & ~1) for k in (0, 1)}  # open pages, framed pages
                out = [clean([x.split(" ") for x in bs], goes[f]) for f, bs in zip(framed, blocks_)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    final = _per_host(shards.select("host", "shard", "page_ids", "urls", "framed", "blocks"), table(both, "repeated-runs"), ["host", "shard"])
    return final.mapInArrow(lean(texts), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
