"""Best-fit packing of tokenised documents into sequences, by length patterns fitted with non-negative least squares.

Only a histogram of lengths (at most `limit` numbers, and one for each LOT pieces of one length) reaches the driver. There the
patterns of up to three documents are enumerated on a length grid, their repeat counts fitted to the histogram by
NNLS and rounded down to what is there; what is left over, and the gaps of the patterns, are packed best-fit decreasing on
counts. The plan is a list of runs "documents of this length, ranks r to r+k, go to sequences s to s+k at offset o",
which tasks look up by binary search. Its size depends on the number of lengths, not of documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.runtime import cut

#: Texts encoded at a time.
ROWS = 2000
#: Pieces of one length that a task ranks at a time.
LOT = 1_000_000
GRID = 256
#: Stretches that a worker remembers the ids of since it last looked for them; twice as many are held at most.
MEMO = 400_000
_encoders: dict[str, _Encoder] = {}


def splits_at_space(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) works on each stretch between ASCII white space by itself.

    True where the first pre-tokenizer removes all but the matches of alternatives none of which can match white space, and no
    added token holds or strips any. Normalizers other than the usual ones by character count as unsafe.
    """
    t = json.loads(tokenizer)
    pre = t.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or not pattern:
        return False
    for part in pattern.split("|"):
        negated = part.startswith("[^")
        if re.search(r"\\[SWDPX]|\.|\s", part) or negated != ("\\s" in part) or part.count("[") > 1:
            return False
    normal = t.get("normalizer") or {}
    for n in normal.get("normalizers") or [normal]:
        space = n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " "
        if n and not space and n["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            return False
    post = t.get("post_processor") is None
    return post and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] for x in t["added_tokens"])


#: The pre-tokenizer's pattern under which a run of letters and a run of ASCII marks after it are tokenised each by itself. Fixed value of the format.
LETTERS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = re.compile(r"""([^\W\d_]+)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)""")


class _Encoder:
    """Ids of texts as bytes; stretches between white space are encoded once and remembered where the tokenizer allows.

    Where it also works on letters and the marks after them by themselves, those are what is encoded and remembered: runs of letters many
    at a time, as every run ends with a token that only stands at the end of one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer, self.split = Tokenizer.from_str(spec), splits_at_space(spec)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        t = json.loads(spec)
        end = t["model"].get("end_of_word_suffix")
        first = ((t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.runs = self.split and bool(end) and (first.get("pattern") or {}).get("Regex") == LETTERS_AND_MARKS
        self.lower = self.runs and any(n["type"] == "Lowercase" for n in (t["normalizer"] or {}).get("normalizers") or [])
        vocabulary = self.tokenizer.get_vocab() if self.runs else {}
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(end)]] = True

    def _encode(self, some: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(some), 10_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some[i : i + 10_000], add_special_tokens=False)]
        return out

    def _encode_letters(self, some: list[str]) -> list[bytes]:
        """The same for runs of letters."""
        out = []
        lots = [some[i : i + 200] for i in range(0, len(some), 200)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(at) == len(lot) + 1 and at[-1] == 4 * len(ids):
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
            else:  # letters that the normalizer turns into something else
                out += self._encode(lot)
        return out

    def _unknown(self, parts: set[str]) -> list[str]:
        """Those that are not remembered; others count as used."""
        for p in parts - self.young.keys():
            x = self.old.get(p)
            if x is not None:
                self.young[p] = x
        return list(parts - self.young.keys())

    def _remembered(self, parts: list[str]) -> list[bytes]:
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        runs, others = {}, set()
        for p in self._unknown(set(parts)):
            m = _LETTERS.fullmatch(p) if self.runs else None
            run = m[1] if m else ""
            if not run or not run.lower().isalpha():
                others.add(p)
                continue
            if self.lower and run.isascii():
                run = run.lower()
            runs[p] = run, m[2]
            if m[2]:
                others.add(m[2])
        young = self.young
        new = self._unknown({run for run, _ in runs.values()})
        young.update(zip(new, self._encode_letters(new), strict=True))
        new = self._unknown(others)
        young.update(zip(new, self._encode(new), strict=True))
        for p, (run, marks) in runs.items():
            young[p] = young[run] + young[marks] if marks else young[run]
        return [young[p] for p in parts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, where each text starts and the last ends)."""
        texts = pc.fill_null(texts, "")
        if not self.split:
            ids = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *map(len, ids)]) // 4
        parts = pc.ascii_split_whitespace(texts)
        words = parts.values.dictionary_encode()
        known = self._remembered(words.dictionary.to_pylist())
        n = np.array([len(x) // 4 for x in known], np.int64)
        flat, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(n) - n
        at = words.indices.to_numpy()
        length = n[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(first[at] - ends[:-1], length) + np.arange(ends[-1])] if ends[-1] else flat[:0]
        offsets = parts.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def tokenize(docs: DataFrame, path: str, limit: int, doc: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `limit` tokens: doc_id, piece, start, length, ids_crc32, and ids where asked for."""

    def pieces(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        encode = _encoders[path]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids, ends = encode(b.column(1))
                n = np.diff(ends) + 1
                count = -(-n // limit)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * limit
                length = np.minimum(n[row] - start, limit)
                crc, kept = np.zeros(len(row), np.int64), []
                for k, (lo, hi, last) in enumerate(zip((ends[row] + start).tolist(), np.minimum(ends[row] + start + limit, ends[row + 1]).tolist(), (start + length == n[row]).tolist(), strict=True)):
                    crc[k] = zlib.crc32(bytes(4), zlib.crc32(ids[lo:hi])) if last else zlib.crc32(ids[lo:hi])
                    if keep_ids:
                        kept.append(np.append(ids[lo:hi], 0) if last else ids[lo:hi])
                columns = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in kept], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by active sets: let in the most useful column, step back where one turns negative.

    Products of columns are made for those inside only; of all pairs of thousands of columns they would take hundreds of MB.
    """
    n = a.shape[1]
    x, inside, ab = np.zeros(n), np.zeros(n, bool), a.T @ b
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[inside] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, np.abs(ab).max()):
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            own = a[:, at]
            z = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(at)), ab[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            inside[at[(x[at] <= 1e-12) & low]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def patterns(parts: int) -> list[tuple[int, ...]]:
    """All ways to write `parts` as a sum of one, two or three positive cells, largest first."""
    out = [(parts,)]
    out += [(parts - j, j) for j in range(1, parts // 2 + 1)]
    out += [(parts - j - k, j, k) for k in range(1, parts // 3 + 1) for j in range(k, (parts - k) // 2 + 1)]
    return out


class _Runs:
    """Documents still to place, by length; taken in rank order."""

    def __init__(self, hist: np.ndarray):
        self.left, self.rank = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.placed.append((length, int(self.rank[length]), n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n


def plan(hist: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """(runs, number of sequences) for hist[length] documents of each length from 1 to limit."""
    runs, cell = _Runs(hist), -(-limit // GRID)
    cells = limit // cell
    of = np.minimum(-(-np.arange(limit + 1) // cell), cells)
    if cells * cell < limit:
        of[cells * cell + 1 :] = cells + 1  # longer than any cell: left to best fit
    have = np.bincount(of, weights=runs.left, minlength=cells + 2)[: cells + 1]
    pats = patterns(cells)
    a = np.zeros((cells + 1, len(pats)))
    for k, p in enumerate(pats):
        for j in p:
            a[j, k] += 1
    fit = nnls(a, have) if have.sum() else np.zeros(len(pats))
    next_sequence, groups = 0, [[] for _ in range(limit + 1)]  # by gap: [first sequence, how many, offset]
    by_cell = [[x for x in range(limit, 0, -1) if of[x] == j] for j in range(cells + 1)]
    for k in sorted(np.flatnonzero(fit >= 0.5), key=lambda k: (len(pats[k]), k)):
        p = pats[k]
        n = int(min([round(fit[k])] + [have[j] // p.count(j) for j in set(p)]))
        open_runs = [[next_sequence, n, 0]] if n else []
        next_sequence += n
        for j in p:
            have[j] -= n
            filled = []
            for s, m, o in open_runs:
                for x in by_cell[j]:
                    if m and (t := min(m, int(runs.left[x]))):
                        runs.put(x, t, s, o)
                        filled.append([s, t, o + x])
                        s, m = s + t, m - t
            open_runs = filled
        for s, m, o in open_runs:
            groups[limit - o].append([s, m, o])
    # Best fit, longest first: the smallest gap that holds the length; a new sequence where none does.
    for x in range(limit, 0, -1):
        gap = x
        while runs.left[x]:
            while gap <= limit and not groups[gap]:
                gap += 1
            if gap > limit:
                n, each = int(runs.left[x]), limit // x
                full, rest = divmod(n, each)
                for m, deep in ((full, each), (1 if rest else 0, rest)):
                    for i in range(deep if m else 0):
                        runs.put(x, m, next_sequence, i * x)
                    if m:
                        groups[limit - deep * x].append([next_sequence, m, deep * x])
                        next_sequence += m
                break
            s, m, o = groups[gap].pop()
            t = min(m, int(runs.left[x]))
            runs.put(x, t, s, o)
            groups[gap - x].append([s, t, o + x])
            if m > t:
                groups[gap].append([s + t, m - t, o])
            if gap - x >= x:
                gap = x
    return np.array(runs.placed, np.int64).reshape(-1, 5), next_sequence


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces with sequence_id and offset added; no sequence holds more than `limit` tokens, each is filled from 0 without gaps.

    pieces needs doc_id, piece, start, length and ids_crc32; it is read several times, so hand over a checkpointed table.
    Equal rows get places of their own. No pieces give no sequences. Pieces of the whole `limit` are sequences by themselves;
    shorter ones are ranked by length in lots of about LOT rows, however many have the same length.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < limit)
    counts = np.zeros(limit + 1, np.int64)
    by_length = cut(short.groupBy("length").count())
    for r in by_length.collect():
        counts[r["length"]] = r["count"]
    runs, used = plan(counts, limit)
    full = pieces.where(F.col("length") == limit).withColumns({"sequence_id": F.monotonically_increasing_id() + used, "offset": F.lit(0).cast("long")})
    lots = -(-counts // LOT)
    many = by_length.select("length", F.ceil(F.col("count") / LOT).cast("int").alias("lots"))  # rows from Python would need workers of another kind
    p = short.join(F.broadcast(many), "length").withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("lots")).cast("int"))
    # How many pieces of a length stand in earlier lots; lot j of length i at base[i] + j.
    base = np.cumsum(lots) - lots
    first = np.zeros(int(lots.sum()), np.int64)
    for r in p.where("lots > 1").groupBy("length", "lot").count().collect():
        first[base[r["length"]] + r["lot"]] = r["count"]
    for i in np.flatnonzero(lots > 1):
        n = first[base[i] : base[i] + lots[i]]
        n[:] = np.cumsum(n) - n
    p = p.select(*pieces.columns, "lot")
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast((runs, (runs[:, 0] << 48) + runs[:, 1], base, first))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches):
        runs, at, base, first = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            rank = first[base[length] + b.column("lot").to_numpy()] + b.column("r").to_numpy() - 1
            k = np.searchsorted(at, (length << 48) + rank, side="right") - 1
            kept = b.drop_columns(["lot", "r"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])], names=[*kept.schema.names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "start", "ids_crc32")
    placed = p.withColumn("r", F.row_number().over(order)).mapInArrow(place, f"{fields}, sequence_id long, offset long")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, path: str, limit: int = 2048, doc: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.

    A null text counts as empty and is one piece of one token (id 0). Only documents of more than `limit` tokens are
    cut. Repeated rows are packed each, in any order among themselves. Other columns of docs are ignored.
    """
    return pack(cut(tokenize(docs, path, limit, doc, text, keep_ids)), limit)
