"""Genotype containers of the public fixed-width layouts, as a Spark data source with variant ranges as partitions.

A file begins with two magic bytes and its mode. Mode 1 (2-bit calls in the older coding) has no counts: the number of samples
is an option. Modes 2 (2-bit ALT counts), 3 (with 16-bit dosages) and 4 (with phase, which scores do not need) give variant
and sample count and have records of one width, so a range of variants is a range of bytes: the driver reads headers only,
a task seeks to its range and decodes blocks of records with numpy into Arrow. Modes whose records are compressed
against each other need the container's own codec and are refused by name.

Mode 0x10 has records of their own widths in blocks of 65,536 variants: a header gives each block's place, and the types and
lengths of its records. Records that stand alone are read and written: all codes (type 0), or the samples that differ from
REF, ALT or missing (types 4, 6 and 7: sorted sample numbers as first ones of 64 and steps), which take space by their number
and not by the cohort's. Types that refer to other records or have dosages, phase or more alleles are refused by name.

Reading gives one row a variant in sparse form: the most frequent dosage (the smallest of equals; null if missing is most
frequent) and the samples that differ. With more than min(n - 1, max(1, 3 * (n // 8))) of those, or one sample only, the row
is dense: its common dosage is 0 and all other dosages are listed. A folder of ``*.pgen`` files is read as consecutive shards.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from additiva.functions.values import DOSAGE_UNIT
from additiva.operators.checks import InputError, checked

MAGIC, MISSING = b"\x6c\x1b", 65535
#: 16-bit dosages of the 2-bit codes, in mode 1 and in the others.
OLD_CODES, CODES = (2 * DOSAGE_UNIT, MISSING, DOSAGE_UNIT, 0), (0, DOSAGE_UNIT, 2 * DOSAGE_UNIT, MISSING)
#: Bytes of a partition, of a block of records in a task, and of a shard that is written.
RANGE_BYTES, BLOCK_BYTES, SHARD_BYTES = 64 << 20, 8 << 20, 64 << 20
#: Variable width: the mode, variants of a block, members of a group of a list, and the types of lists by the code they differ from.
VARIABLE, BLOCK_VARIANTS, GROUP, LISTS = 0x10, 1 << 16, 64, {0: 4, 2: 6, 3: 7}
#: Records, and their bytes, that a reading task decodes and gives out at a time. A listed sample takes more than a byte.
BATCH_RECORDS, BATCH_BYTES = 2048, 1 << 20
SCHEMA = "pgen_variant_idx long, common double, dense boolean, exceptions array<struct<sample_idx: long, dosage: double>>"
_ARROW = pa.schema([("pgen_variant_idx", pa.int64()), ("common", pa.float64()), ("dense", pa.bool_()), ("exceptions", pa.list_(pa.struct([("sample_idx", pa.int64()), ("dosage", pa.float64())])))])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_width(mode: int, samples: int) -> int:
    return (samples + 3) // 4 + {1: 0, 2: 0, 3: 2, 4: 4}[mode] * samples


@dataclass
class Layout:
    path: str
    mode: int
    variants: int
    samples: int
    start: int
    first: int = 0
    form: int = 0
    places: tuple[int, ...] = ()
    size: int = 0

    @property
    def width(self) -> int:
        return record_width(self.mode, self.samples)


def layout_of(path: str, samples: int | None = None) -> Layout:
    """Reads a header. The file's size must be that of its records."""
    system, place = _place(path)
    with system.open_input_file(place) as f:
        size, head = f.size(), f.read(12)
        offsets = f.read(8 * -(-struct.unpack("<I", head[3:7])[0] // BLOCK_VARIANTS)) if head[2:3] == bytes([VARIABLE]) and len(head) == 12 else b""
    if head[:2] != MAGIC or len(head) < 3:
        raise InputError(f"{path} is no genotype container")
    mode = head[2]
    if mode == 1:
        if not samples:
            raise InputError(f"{path}: mode 1 has no counts; give the number of samples")
        width = record_width(1, samples)
        variants, start = (size - 3) // width, 3
    elif mode in (2, 3, 4):
        if len(head) < 12:
            raise InputError(f"{path} is cut short")
        variants, found = struct.unpack("<II", head[3:11])
        if samples and samples != found:
            raise InputError(f"{path} has {found} samples, not {samples}")
        samples = found
        # The two high bits of the last byte say whether a bit a variant follows the header.
        start = 12 + ((variants + 7) // 8 if head[11] >> 6 == 3 else 0)
    elif mode == VARIABLE and len(head) == 12:
        variants, found = struct.unpack("<II", head[3:11])
        if samples and samples != found:
            raise InputError(f"{path} has {found} samples, not {samples}")
        if not variants or not found:
            raise InputError(f"{path}: a compressed container must contain at least one sample and variant")
        if head[11] & 0x38:
            raise InputError(f"{path}: compressed records of several alleles or of another form are not read")
        if len(offsets) % 8 or len(offsets) // 8 != -(-variants // BLOCK_VARIANTS):
            raise InputError(f"{path} is cut short")
        out = Layout(path, mode, variants, found, 12 + len(offsets), form=head[11], places=struct.unpack(f"<{len(offsets) // 8}Q", offsets), size=size)
        if list(out.places) != sorted(out.places) or out.places[0] != out.start + sum(_block_head(out, k) for k in range(len(out.places))) or out.places[-1] > size:
            raise InputError(f"{path}: blocks do not follow the header")
        return out
    else:
        raise InputError(f"{path}: mode {mode:#x} is compressed; only fixed-width modes 1 to 4 and 0x10 are read")
    if not variants or not samples:
        raise InputError(f"{path} must contain at least one sample and variant")
    out = Layout(path, mode, variants, samples, start)
    if size != start + variants * out.width:
        raise InputError(f"{path} has {size} bytes, not {start + variants * out.width} for {variants} variants and {samples} samples")
    return out


def _block_variants(x: Layout, block: int) -> int:
    return min(BLOCK_VARIANTS, x.variants - block * BLOCK_VARIANTS)


def _block_head(x: Layout, block: int) -> int:
    """Bytes of a block's types, lengths and, if stored, bits."""
    n = _block_variants(x, block)
    return (n if x.form & 4 else (n + 1) // 2) + n * ((x.form & 3) + 1) + ((n + 7) // 8 if x.form >> 6 == 3 else 0)


def _records(f: pa.NativeFile, x: Layout, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(types, places) of a block's records; the last place is the end."""
    n, wide = _block_variants(x, block), (x.form & 3) + 1
    f.seek(x.start + sum(_block_head(x, k) for k in range(block)))
    head = np.frombuffer(f.read(_block_head(x, block)), np.uint8)
    kinds = head[:n] if x.form & 4 else np.stack([head[: (n + 1) // 2] & 15, head[: (n + 1) // 2] >> 4], axis=1).ravel()[:n]
    at = n if x.form & 4 else (n + 1) // 2
    lengths = (head[at : at + n * wide].reshape(n, wide).astype(np.int64) << (8 * np.arange(wide))).sum(axis=1)
    places = x.places[block] + np.append(0, np.cumsum(lengths))
    if places[-1] != (x.places[block + 1] if block + 1 < len(x.places) else x.size):
        raise InputError(f"{x.path}: the records of block {block} do not end where the next begins")
    return kinds, places


def layouts(path: str, samples: int | None = None) -> list[Layout]:
    """One file, or the shards of a folder in order of their names."""
    system, place = _place(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [layout_of(path, samples)]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".pgen"))
    if not names:
        raise InputError(f"{path} has no shards")
    out: list[Layout] = []
    for n in names:
        x = layout_of(f"{path}/{n}", samples)
        if out and x.samples != out[0].samples:
            raise InputError(f"{x.path} has {x.samples} samples, not {out[0].samples}")
        x.first = out[-1].first + out[-1].variants if out else 0
        out.append(x)
    return out


def decoded(records: np.ndarray, mode: int, samples: int) -> np.ndarray:
    """16-bit dosages (variants x samples), 65535 where missing."""
    quarter = (samples + 3) // 4
    codes = ((records[:, :quarter, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(records), -1)[:, :samples]
    out = np.array(OLD_CODES if mode == 1 else CODES, np.int64)[codes]
    if mode > 2:
        exact = np.ascontiguousarray(records[:, quarter : quarter + 2 * samples]).view("<u2").astype(np.int64)
        out = np.where(exact == MISSING, out, exact)
        if ((out > 2 * DOSAGE_UNIT) & (out != MISSING)).any():
            raise InputError("a dosage is above 2")
    return out


def _numbers(data: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` numbers of seven bits a byte, the high bit set before the last one."""
    ends = np.flatnonzero(data < 128)[:count]
    if len(ends) < count:
        raise InputError("a record is cut short")
    if not count:
        return np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    part = data[: ends[-1] + 1].astype(np.int64) & 127
    return np.add.reduceat(part << (7 * (np.arange(len(part)) - np.repeat(starts, ends - starts + 1))), starts)


def _spelled(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same the other way round: (bytes, bytes of each number)."""
    width = 1 + sum((numbers >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(width) - width
    step = np.arange(width.sum()) - np.repeat(starts, width)
    high = np.where(step < np.repeat(width, width) - 1, 128, 0)
    return (np.repeat(numbers, width) >> (7 * step) & 127 | high).astype(np.uint8), width


def _quarters(codes: np.ndarray) -> bytes:
    padded = np.zeros((len(codes) + 3) // 4 * 4, np.uint8)
    padded[: len(codes)] = codes
    return (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _codes(data: np.ndarray, count: int) -> np.ndarray:
    return ((data[: (count + 3) // 4, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[:count]


def _sample_bytes(samples: int) -> int:
    return (samples.bit_length() + 7) // 8


def listed_record(who: np.ndarray, codes: np.ndarray, base: int, samples: int) -> tuple[int, bytes]:
    """(type, record) of a variant whose samples have code ``base``, but for those of ``who``, sorted. Long lists and lists against one ALT allele become all codes."""
    differ = codes != base
    who, codes = who[differ], codes[differ]
    n = len(who)
    if base not in LISTS or n > samples // 8:
        whole = np.full(samples, base, np.uint8)
        whole[who] = codes
        return 0, _quarters(whole)
    if not n:
        return LISTS[base], b"\0"
    wide, inner = _sample_bytes(samples), np.arange(n) % GROUP > 0
    steps, width = _spelled(np.diff(who, prepend=who[:1])[inner])
    groups = -(-n // GROUP)
    sizes = np.bincount((np.arange(n) // GROUP)[inner], weights=width, minlength=groups)[:-1] - (GROUP - 1)
    firsts = np.ascontiguousarray(who[::GROUP].astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :wide]
    return LISTS[base], _spelled(np.array([n]))[0].tobytes() + firsts.tobytes() + sizes.astype(np.uint8).tobytes() + _quarters(codes) + steps.tobytes()


def listed_records(counts: np.ndarray, who: np.ndarray, codes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of ``listed_record`` against REF of many variants at once: ``counts`` samples of each one after the other, none with code 0."""
    wide, groups, (head, head_width) = _sample_bytes(samples), -(-counts // GROUP), _spelled(counts)
    variant = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(who)) - (np.cumsum(counts) - counts)[variant]
    inner = at % GROUP > 0
    steps, width = _spelled(np.diff(who, prepend=0)[inner])
    of_steps = np.bincount(variant[inner], weights=width, minlength=len(counts)).astype(np.int64)
    to_sizes = head_width + groups * wide
    to_codes = to_sizes + np.maximum(groups - 1, 0)
    to_steps = to_codes + (counts + 3) // 4
    ends = np.append(0, np.cumsum(to_steps + of_steps))
    starts, out = ends[:-1], np.zeros(ends[-1], np.uint8)
    spread = lambda first, n: np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out[spread(starts, head_width)] = head
    first = np.flatnonzero(~inner)
    for k in range(wide):
        out[(starts + head_width)[variant[first]] + at[first] // GROUP * wide + k] = who[first] >> (8 * k) & 255
    group = np.cumsum(~inner) - 1
    sizes = np.bincount(group[inner], weights=width, minlength=len(first)).astype(np.int64) - (GROUP - 1)
    whole = at[first] // GROUP < groups[variant[first]] - 1
    out[(starts + to_sizes)[variant[first[whole]]] + at[first[whole]] // GROUP] = sizes[whole]
    for k in range(4):
        some = np.flatnonzero(at % 4 == k)
        out[(starts + to_codes)[variant[some]] + at[some] // 4] |= (codes[some] << (2 * k)).astype(np.uint8)
    out[spread(starts + to_steps, of_steps)] = steps
    return out, ends


def record_list(kind: int, data: np.ndarray, samples: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(base, who, codes) of a record: samples that are not in ``who`` have the code ``base``."""
    if kind == 0:
        codes = _codes(data, samples)
        if len(codes) < samples:
            raise InputError("a record is cut short")
        return 0, np.arange(samples), codes
    base = {t: b for b, t in LISTS.items()}.get(kind)
    if base is None:
        raise InputError(f"records of type {kind:#x} are compressed against others or have more than calls; types 0, 4, 6 and 7 are read")
    n = int(_numbers(data[:5], 1)[0])
    if not n:
        return base, np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at, wide, groups = len(_spelled(np.array([n]))[0]), _sample_bytes(samples), -(-n // GROUP)
    firsts = (data[at : at + groups * wide].reshape(groups, wide).astype(np.int64) << (8 * np.arange(wide))).sum(axis=1)
    at += groups * wide + groups - 1
    codes = _codes(data[at:], n)
    steps = np.zeros(n, np.int64)
    steps[np.arange(n) % GROUP > 0] = _numbers(data[at + (n + 3) // 4 :], n - groups)
    total = np.cumsum(steps)
    who = total + np.repeat(firsts - total[::GROUP], np.minimum(GROUP, n - GROUP * np.arange(groups)))
    if who[-1] >= samples or (np.diff(who) <= 0).any():
        raise InputError("the samples of a record are not in order")
    return base, who, codes


def listed_row(kind: int, data: np.ndarray, samples: int) -> tuple[float | None, bool, np.ndarray, np.ndarray]:
    """(common, dense, samples, codes) by the rule of ``sparse_rows``; only where another code than the list's is common are all samples spelled out."""
    base, who, codes = record_list(kind, data, samples)
    counts = np.bincount(codes, minlength=4)
    counts[base] += samples - len(who)
    best = int(np.argmax(counts))
    dense = samples == 1 or samples - int(counts[best]) > most_exceptions(samples)
    common = 0 if dense else best
    if common != base and len(who) < samples:
        whole = np.full(samples, base, np.uint8)
        whole[who] = codes
        who, codes = np.arange(samples), whole
    differ = codes != common
    return None if common == 3 else float(common), dense, who[differ], codes[differ]


def listed_rows(kinds: np.ndarray, data: np.ndarray, places: np.ndarray, samples: int) -> tuple[np.ndarray, ...] | None:
    """(common code, dense, counts, samples, codes) of many records at once, as ``listed_row`` gives them one by one; None if one is no plain list against its most frequent code."""
    base = np.full(256, -1)
    base[list(LISTS.values())] = list(LISTS)
    base, starts, ends = base[kinds], places[:-1], places[1:]
    if (base < 0).any() or not len(data):
        return None
    n, head, more = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64), np.ones(len(kinds), bool)
    for k in range(5):
        byte = data[np.minimum(starts + k, len(data) - 1)].astype(np.int64)
        n[more] |= (byte[more] & 127) << (7 * k)
        head[more] += 1
        more &= byte > 127
    wide, groups = _sample_bytes(samples), -(-n // GROUP)
    to_codes = starts + head + groups * wide + np.maximum(groups - 1, 0)
    to_steps = np.where(n > 0, to_codes + (n + 3) // 4, ends)
    if more.any() or (to_steps > ends).any():
        return None
    spread = lambda first, m: np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
    steps = data[spread(to_steps, ends - to_steps)]
    last = steps < 128
    of_steps = np.bincount(np.repeat(np.arange(len(n)), ends - to_steps)[last], minlength=len(n))
    if (of_steps != n - groups).any() or (data[ends[n > groups] - 1] > 127).any():
        return None
    variant = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(variant)) - (np.cumsum(n) - n)[variant]
    first = np.flatnonzero(at % GROUP == 0)
    begin = np.zeros(len(first), np.int64)
    for k in range(wide):
        begin |= data[(starts + head)[variant[first]] + at[first] // GROUP * wide + k].astype(np.int64) << (8 * k)
    codes = data[to_codes[variant] + at // 4] >> (2 * (at % 4)).astype(np.uint8) & 3
    step = np.zeros(len(variant), np.int64)
    step[at % GROUP > 0] = _numbers(steps, int((n - groups).sum()))
    total = np.cumsum(step)
    who = total + np.repeat(begin - total[first], np.diff(np.append(first, len(variant))))
    if (who >= samples).any() or ((np.diff(who) <= 0) & (np.diff(variant) == 0)).any():
        raise InputError("the samples of a record are not in order")
    counts = np.bincount(variant * 4 + codes, minlength=4 * len(n)).reshape(-1, 4)
    counts[np.arange(len(n)), base] += samples - n
    best = counts.argmax(axis=1)
    dense = (samples - counts.max(axis=1) > most_exceptions(samples)) | (samples == 1)
    common = np.where(dense, 0, best)
    if ((common != base) & (n < samples)).any():
        return None
    kept = codes != common[variant]
    return common, dense, np.bincount(variant[kept], minlength=len(n)), who[kept], codes[kept]


def most_exceptions(samples: int) -> int:
    return min(samples - 1, max(1, 3 * (samples // 8)))


def sparse_rows(first: int, dosages: np.ndarray) -> pa.RecordBatch:
    """The rows of consecutive variants."""
    n = dosages.shape[1]
    common, dense = np.zeros(len(dosages), np.int64), np.zeros(len(dosages), bool)
    for k, row in enumerate(dosages):
        values, counts = np.unique(row, return_counts=True)
        best = int(np.argmax(counts))
        dense[k] = n == 1 or n - counts[best] > most_exceptions(n)
        common[k] = 0 if dense[k] else values[best]
    at, sample = np.nonzero(dosages != common[:, None])
    value = dosages[at, sample]
    listed = pa.StructArray.from_arrays([pa.array(sample.astype(np.int64)), pa.array(value / DOSAGE_UNIT, mask=value == MISSING)], names=["sample_idx", "dosage"])
    ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(dosages)))).astype(np.int32)
    columns = [pa.array(np.arange(first, first + len(dosages))), pa.array(common / DOSAGE_UNIT, mask=common == MISSING), pa.array(dense), pa.ListArray.from_arrays(pa.array(ends), listed)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _listed_batch(first: int, common: np.ndarray, dense: np.ndarray, counts: np.ndarray, who: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    listed = pa.StructArray.from_arrays([pa.array(who.astype(np.int64)), pa.array(codes.astype(np.float64), mask=codes == 3)], names=["sample_idx", "dosage"])
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    columns = [pa.array(np.arange(first, first + len(common))), pa.array(common.astype(np.float64), mask=common == 3), pa.array(dense), pa.ListArray.from_arrays(pa.array(ends), listed)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Range(InputPartition):
    def __init__(self, layout: Layout, begin: int, end: int) -> None:
        self.layout, self.begin, self.end = layout, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = layouts(options["path"], int(options["samples"]) if options.get("samples") else None)
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for x in self.files:
            if x.mode == VARIABLE:
                # A block's records have about the same width: its places are read by the tasks.
                for k, place in enumerate(x.places):
                    n, whole = _block_variants(x, k), (x.places[k + 1] if k + 1 < len(x.places) else x.size) - place
                    step = max(1, n * self.bytes // max(1, whole))
                    out += [_Range(x, k * BLOCK_VARIANTS + a, k * BLOCK_VARIANTS + min(a + step, n)) for a in range(0, n, step)]
                continue
            step = max(1, self.bytes // x.width)
            out += [_Range(x, a, min(a + step, x.variants)) for a in range(0, x.variants, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        x, step = partition.layout, max(1, BLOCK_BYTES // (4 * partition.layout.samples))
        system, place = _place(x.path)
        with system.open_input_file(place) as f:
            if x.mode == VARIABLE:
                yield from self._variable(f, x, partition.begin, partition.end)
                return
            for a in range(partition.begin, partition.end, step):
                k = min(step, partition.end - a)
                f.seek(x.start + a * x.width)
                records = np.frombuffer(f.read(k * x.width), np.uint8).reshape(k, x.width)
                yield sparse_rows(x.first + a, decoded(records, x.mode, x.samples))


    @staticmethod
    def _variable(f: pa.NativeFile, x: Layout, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        kinds, places = _records(f, x, begin // BLOCK_VARIANTS)
        kinds, places = _records(f, x, begin // BLOCK_VARIANTS)
        origin = begin // BLOCK_VARIANTS * BLOCK_VARIANTS
        at, last = begin - origin, end - origin
        while at < last:
            # Some records at once, one at least.
            upto = max(at + 1, min(last, at + BATCH_RECORDS, int(np.searchsorted(places, places[at] + BATCH_BYTES, "right")) - 1))
            f.seek(int(places[at]))
            data, ends = np.frombuffer(f.read(int(places[upto] - places[at])), np.uint8), places[at : upto + 1] - places[at]
            found = listed_rows(kinds[at:upto], data, ends, x.samples)
            if found is None:
                common, dense, who, codes = zip(*(listed_row(int(kinds[at + k]), data[ends[k] : ends[k + 1]], x.samples) for k in range(upto - at)), strict=True)
                found = np.array([3 if c is None else int(c) for c in common]), np.array(dense), np.array([len(w) for w in who]), np.concatenate(who), np.concatenate(codes)
            yield _listed_batch(x.first + origin + at, *found)
            at = upto


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Each task writes complete shards from rows (pgen_variant_idx, record) in order; they are named by their first variant."""

    def __init__(self, options: dict) -> None:
        self.path, self.mode, self.samples = options["path"], int(options.get("mode", 2)), int(options["samples"])

    def write(self, iterator) -> _Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        names, held, kinds, first, size = [], [], [], 0, 0

        def out() -> None:
            name = f"{first:012d}.pgen"
            with system.open_output_stream(posixpath.join(folder, f".{name}")) as f:
                f.write(MAGIC + struct.pack("<BIIB", self.mode, len(held), self.samples, 0x43 if self.mode == VARIABLE else 0x40))
                if self.mode == VARIABLE:
                    # One block: its place, types of four bits, lengths of four bytes.
                    kind = np.array(kinds + [0] * (len(kinds) % 2), np.uint8)
                    f.write(struct.pack("<Q", 20 + len(kind) // 2 + 4 * len(held)) + (kind[::2] | kind[1::2] << 4).tobytes() + np.array([len(r) for r in held], "<u4").tobytes())
                f.write(b"".join(held))
            names.append(name)

        variable = self.mode == VARIABLE
        width = 0 if variable else record_width(self.mode, self.samples)
        for row in iterator:
            if not variable and len(row["record"]) != width:
                raise InputError(f"record of {len(row['record'])} bytes, not {width}")
            if size >= SHARD_BYTES or variable and len(held) == BLOCK_VARIANTS:
                out()
                held, kinds, size = [], [], 0
            if not held:
                first = row["pgen_variant_idx"]
            held.append(bytes(row["record"]))
            size += len(held[-1])
            if variable:
                kinds.append(row["kind"])
        if held:
            out()
        return _Written(names)

    def commit(self, messages: list[_Written]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(posixpath.join(folder, f".{name}"), posixpath.join(folder, name))

    def abort(self, messages: list[_Written]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(posixpath.join(folder, f".{name}"))


class PgenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgen"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read_pgen(spark: SparkSession, path: str, samples: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of ``SCHEMA``, one a variant."""
    spark.dataSource.register(PgenSource)
    options = {"path": path, "rangeBytes": str(range_bytes)} | ({"samples": str(samples)} if samples else {})
    return spark.read.format("pgen").options(**options).load()


def mode_of(path: str) -> int:
    system, place = _place(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        return 2
    with system.open_input_file(place) as f:
        head = f.read(3)
    return head[2] if len(head) == 3 else 0


def counts_of(path: str, samples: int | None = None) -> tuple[int, int]:
    """(variants, samples), from the headers."""
    files = layouts(path, samples)
    return sum(x.variants for x in files), files[0].samples


def calls_and_common(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pgen_variant_idx, sample_idx, dosage) and (pgen_variant_idx, common) as scoring takes them."""
    calls = rows.select("pgen_variant_idx", F.explode("exceptions").alias("x")).select("pgen_variant_idx", "x.sample_idx", "x.dosage")
    return calls, rows.select("pgen_variant_idx", "common")


def encoded(dosages: np.ndarray, mode: int) -> bytes:
    """One record from 16-bit dosages (65535: missing). Mode 2 holds whole ALT counts only."""
    packed = _quarters(np.where(dosages == MISSING, 3, (dosages + DOSAGE_UNIT // 2) // DOSAGE_UNIT).astype(np.uint8))
    if mode == 2:
        if ((dosages != MISSING) & (dosages % DOSAGE_UNIT != 0)).any():
            raise InputError("mode 2 holds whole dosages only")
        return packed
    return packed + dosages.astype("<u2").tobytes()


def _listed_records(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Records of calls that come sorted by variant and sample; a row with sample -1 only names its variant. Calls of a variant without such a row are left out."""
    schema = pa.schema([("pgen_variant_idx", pa.int64()), ("kind", pa.int32()), ("record", pa.binary())])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows(variant: np.ndarray, who: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(0, np.flatnonzero(np.diff(variant)) + 1)
        of = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(variant))))
        names = variant[cuts[who[cuts] < 0]]
        # Numbers of the variants with a row of their own, and the calls of these.
        number = np.cumsum(who[cuts] < 0) - 1
        real = (who >= 0) & (who[cuts] < 0)[of]
        of, who, code = number[of[real]], who[real], code[real]
        twice = np.flatnonzero((np.diff(of) == 0) & (np.diff(who) <= 0))
        if len(twice):
            raise InputError(f"variant {names[of[twice[0]]]} lists a sample twice")
        # The base is the most frequent code, that of the unlisted samples being 0.
        counts = np.bincount(of * 4 + code, minlength=4 * len(names)).reshape(-1, 4)
        listed = counts.sum(axis=1)
        counts[:, 0] += samples - listed
        best, ends = counts.argmax(axis=1), np.append(0, np.cumsum(listed))
        plain = (best == 0) & (samples - counts[:, 0] <= samples // 8)
        some = plain[of] & (code != 0)
        data, places = listed_records(np.bincount(of[some], minlength=len(names))[plain], who[some], code[some], samples)
        kinds, records = np.full(len(names), LISTS[0]), np.empty(len(names), object)
        records[plain] = [data[a:b].tobytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            whose, codes = who[ends[k] : ends[k + 1]], code[ends[k] : ends[k + 1]]
            if best[k] and listed[k] < samples:
                whole = np.zeros(samples, np.uint8)
                whole[whose] = codes
                whose, codes = np.arange(samples), whole
            kinds[k], records[k] = listed_record(whose, codes, int(best[k]), samples)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.binary())], schema=schema)

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([h[k] for h in held]) for k in range(3))

    for b in batches:
        part = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(part[0]):
            continue
        last = int(np.searchsorted(part[0], part[0][-1]))
        # The last variant may go on in the next batch.
        if held and held[0][0][0] != part[0][-1]:
            held.append(tuple(x[:last] for x in part))
            yield rows(*whole())
            held = []
        elif last:
            yield rows(*(x[:last] for x in part))
        held.append(tuple(x[last:] for x in part))
    if held:
        yield rows(*whole())


def write_pgen(calls: DataFrame, variants: DataFrame, samples: int, path: str, mode: int = 2, parts: int | None = None) -> None:
    """Shards of all ``variants`` (pgen_variant_idx), from calls (pgen_variant_idx, sample_idx from 0 on, dosage; null: missing); samples without a call have dosage 0.

    A task holds one variant's dosages at a time. Modes 2 and 3 take space for every sample of every variant, mode 0x10 (whole
    dosages only) for the listed calls: those are sorted by variant and sample in ranges, ``parts`` of them or as the session has it, and encoded as they come.
    """
    if mode not in (2, 3, VARIABLE):
        raise InputError(f"mode {mode} is not written")
    if mode == VARIABLE:
        dosage, who = F.col("dosage").cast("double"), F.col("sample_idx").cast("long")
        code = F.when(dosage.isNull(), 3).otherwise(checked(dosage, ~dosage.isin(0.0, 1.0, 2.0), "whole dosages only", dosage)).cast("byte")
        who = checked(who, who.isNull() | (who < 0) | (who >= samples), "no such sample", who)
        cells = calls.select(F.col("pgen_variant_idx").cast("long").alias("pgen_variant_idx"), who.alias("sample_idx"), code.alias("code"))
        cells = cells.unionByName(variants.select(F.col("pgen_variant_idx").cast("long").alias("pgen_variant_idx"), F.lit(-1).cast("long").alias("sample_idx"), F.lit(0).cast("byte").alias("code")))
        calls.sparkSession.dataSource.register(PgenSource)
        ordered = (cells.repartitionByRange(parts, "pgen_variant_idx") if parts else cells.repartitionByRange("pgen_variant_idx")).sortWithinPartitions("pgen_variant_idx", "sample_idx")
        ordered.mapInArrow(partial(_listed_records, samples=samples), "pgen_variant_idx long, kind int, record binary").write.format("pgen").options(path=path, mode=str(mode), samples=str(samples)).mode("append").save()
        return

    def record(key: tuple, listed: pa.Table, known: pa.Table) -> pa.Table:
        dosages = np.zeros(samples, np.int64)
        if listed.num_rows:
            value = listed["dosage"].to_numpy()
            dosages[listed["sample_idx"].to_numpy()] = np.where(np.isnan(value), MISSING, np.rint(np.nan_to_num(value) * DOSAGE_UNIT))
        return pa.table({"pgen_variant_idx": [key[0].as_py()] * known.num_rows, "record": [encoded(dosages, mode)] * known.num_rows}, schema=pa.schema([("pgen_variant_idx", pa.int64()), ("record", pa.binary())]))

    typed = calls.select(F.col("pgen_variant_idx").cast("long").alias("pgen_variant_idx"), F.col("sample_idx").cast("long").alias("sample_idx"), F.coalesce(F.col("dosage").cast("double"), F.lit(float("nan"))).alias("dosage"))
    known = variants.select(F.col("pgen_variant_idx").cast("long").alias("pgen_variant_idx")).distinct()
    rows = typed.groupBy("pgen_variant_idx").cogroup(known.groupBy("pgen_variant_idx")).applyInArrow(record, "pgen_variant_idx long, record binary")
    calls.sparkSession.dataSource.register(PgenSource)
    rows.repartitionByRange("pgen_variant_idx").sortWithinPartitions("pgen_variant_idx").write.format("pgen").options(path=path, mode=str(mode), samples=str(samples)).mode("append").save()
