"""Encrypted columns: element-wise encryption, weighted sums on ciphertexts, one decryption per element.

A ciphertext travels as ``struct<ciphertext string, exponent int>`` (decimal text, too wide for any SQL number).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.functions.paillier import SCALE_BITS, Decryptor, Encryptor, Packing, PrivateKey, PublicKey, packing

CIPHER = T.StructType([T.StructField("ciphertext", T.StringType()), T.StructField("exponent", T.IntegerType())])
OUT_ROWS = 2_000
OPEN_WEIGHTS = 1_000  # distinct weights whose products a task keeps


def he_encrypt(df: DataFrame, col: str, key: PublicKey, name: str = "cipher", tasks: int | None = None) -> DataFrame:
    """Replace ``col`` by its ciphertext; NULL and NaN stay without one. ``tasks`` spreads the rows first, as one value costs far more than moving it."""
    schema = _replace(df.schema, col, T.StructField(name, CIPHER))
    at = df.columns.index(col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        encryptor = None
        for batch in batches:
            encryptor = encryptor or Encryptor(key)
            ciphers = [
                None if v is None or v != v else {"ciphertext": str(encryptor.encrypt(v)), "exponent": -SCALE_BITS}
                for v in batch.column(at).to_pylist()
            ]
            columns = batch.columns
            columns[at] = pa.array(ciphers, arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    spread = df.repartition(tasks) if tasks else df
    return spread.mapInArrow(run, schema)


def he_decrypt(
    df: DataFrame, cipher: str, key: PrivateKey, name: str = "value", divisor: str | None = None
) -> DataFrame:
    """Replace a ciphertext column by its number, divided by the integer column ``divisor`` if given."""
    schema = _replace(df.schema, cipher, T.StructField(name, T.DoubleType()))
    at = df.columns.index(cipher)
    by = None if divisor is None else df.columns.index(divisor)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        decryptor = Decryptor(key)
        for batch in batches:
            ciphers = _numbers(batch.column(at))
            divisors = [1] * len(ciphers) if by is None else batch.column(by).to_pylist()
            values = [
                None if c is None or not d else decryptor.value(c, d)
                for c, d in zip(ciphers, divisors, strict=True)
            ]
            columns = batch.columns
            columns[at] = pa.array(values, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def he_weighted_sum(
    df: DataFrame,
    by: Sequence[str],
    key: PublicKey,
    cipher: str = "cipher",
    weight: str = "num_samples",
    tasks: int | None = None,
    bits: int = SCALE_BITS,
) -> DataFrame:
    """``sum(weight * x)`` on ciphertexts, with the plain total weight: ``(by.., cipher, weight)``.

    Only rows with a ciphertext and a weight of zero or more count. Each task first sorts what it holds and multiplies it
    per group, so a group reaches the shuffle with one row per task however many clients or groups there are; the second
    fold walks sorted groups too. The first keeps a product per distinct weight of one group, at most ``OPEN_WEIGHTS``, the second one product. Its ``tasks`` (the
    session's shuffle partitions) are set outright: merging partitions that are small in bytes would pile up work.
    """
    by = list(by)
    rows = df.select(*by, cipher, F.col(weight).cast("bigint").alias(weight)).where(F.col(cipher).isNotNull() & (F.col(weight) >= 0))
    partial = rows.sortWithinPartitions(*by).mapInArrow(_fold(rows.schema, len(by), key, True, bits), rows.schema)
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = partial.repartition(tasks, *by).sortWithinPartitions(*by)
    return grouped.mapInArrow(_fold(rows.schema, len(by), key, False, bits), rows.schema)


def plan_packing(df: DataFrame, key: PublicKey, by: Sequence[str] = (), col: str = "value", weight: str | None = None, bits: int = 64) -> Packing:
    """The slots that the column's largest number, and with ``weight`` the largest total weight of a ``by`` group, leave room for."""
    size = F.max(F.when(~F.isnan(col), F.abs(col)))
    if weight is None:
        largest, total = df.agg(size).first()[0], 1
    else:
        groups = df.groupBy(*by).agg(size.alias("v"), F.sum(weight).alias("w"))
        largest, total = groups.agg(F.max("v"), F.max("w")).first()
    return packing(key, largest or 0.0, total or 1, bits)


def he_encrypt_packed(
    df: DataFrame, by: Sequence[str], key: PublicKey, plan: Packing, col: str = "value", index: str = "idx", weight: str | None = None, tasks: int | None = None
) -> DataFrame:
    """One ciphertext per ``by`` group and block of ``plan.slots`` positions: ``(by.., block, filled, cipher[, weight])``.

    ``filled`` lists the slots that hold a number; rows with NULL or NaN have none. ``weight`` is one number per group.
    """
    by, keep = list(by), [weight] if weight else []
    at = F.col(index).cast("bigint")
    known = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    slot = F.struct(F.pmod(at, F.lit(plan.slots)).cast("int").alias("slot"), F.col(col).cast("double").alias("x"))
    rows = known.select(*by, F.floor(at / plan.slots).cast("bigint").alias("block"), slot.alias("e"), *keep)
    held = [F.max(weight).alias(weight)] if weight else []
    blocks = rows.groupBy(*by, "block").agg(F.sort_array(F.collect_list("e")).alias("values"), *held)
    blocks = blocks.select(*by, "block", F.col("values.slot").alias("filled"), F.col("values.x").alias("values"), *keep)
    schema = _replace(blocks.schema, "values", T.StructField("cipher", CIPHER))
    slots, place = blocks.columns.index("filled"), blocks.columns.index("values")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, encryptor = to_arrow_schema(schema), None
        for batch in batches:
            encryptor = encryptor or Encryptor(key)
            held = zip(_lists(batch.column(slots)), _lists(batch.column(place)), strict=True)
            packed = [plan.pack(dict(zip(filled, values, strict=True))) for filled, values in held]
            columns = batch.columns
            columns[place] = pa.array([{"ciphertext": str(encryptor.encrypt_integer(m)), "exponent": -plan.bits} for m in packed], arrow.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    spread = blocks.repartition(tasks) if tasks else blocks
    return spread.mapInArrow(run, schema)


def he_decrypt_packed(df: DataFrame, by: Sequence[str], key: PrivateKey, plan: Packing, index: str = "idx", divisors: str | None = None) -> DataFrame:
    """``(by.., idx, value)`` of packed ciphertexts; ``divisors`` is an array beside ``filled`` to divide by."""
    by = list(by)
    rows = df.select(*by, "block", "filled", divisors or F.transform("filled", lambda _: F.lit(1).cast("bigint")).alias("by"), "cipher")
    schema = T.StructType([*df.select(*by).schema.fields, T.StructField(index, T.LongType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, decryptor = to_arrow_schema(schema), Decryptor(key, plan.bits)
        for batch in batches:
            out = []
            *groups, filled_, divisors_, ciphers = batch.columns
            columns = [*[c.to_pylist() for c in groups], _lists(filled_), _lists(divisors_), _numbers(ciphers, plan.bits)]
            for *group, block, filled, by_, cipher in zip(*columns, strict=True):
                sums = plan.unpack(decryptor.decrypt(cipher))
                out += [(*group, block * plan.slots + s, sums[s] / (d << plan.bits) if d else None) for s, d in zip(filled, by_, strict=True)]
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def he_fedavg_packed(df: DataFrame, by: Sequence[str], key: PrivateKey, plan: Packing, weight: str = "num_samples", index: str = "idx") -> DataFrame:
    """Weighted mean per ``by`` and position of packed updates; a number counts with its own client's weight, a missing one does not.

    Products and the plain weights per slot are added up separately and meet by block for one decryption each.
    """
    by, usable = list(by), df.where(F.col(weight) >= 0)
    total = he_weighted_sum(usable, [*by, "block"], key.public, "cipher", weight, bits=plan.bits).drop(weight)
    slots = usable.select(*by, "block", F.explode("filled").alias("slot"), weight).groupBy(*by, "block", "slot").agg(F.sum(weight).cast("bigint").alias("w"))
    sums = slots.groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("slot", "w"))).alias("s"))  # of a block's slots
    sums = sums.select(*by, "block", F.col("s.slot").alias("filled"), F.col("s.w").alias("weights"))
    return he_decrypt_packed(total.join(sums, [*by, "block"]), by, key, plan, index, "weights")


def he_fedavg(
    df: DataFrame, by: Sequence[str], key: PrivateKey, cipher: str = "cipher", weight: str = "num_samples"
) -> DataFrame:
    """Weighted mean per element with one decryption per element; NULL when the total weight is zero."""
    total = he_weighted_sum(df, by, key.public, cipher, weight)
    return he_decrypt(total, cipher, key, "value", weight).select(*by, "value")


def to_wire(cipher: str | Column) -> Column:
    return F.to_json(cipher)


def from_wire(text: str | Column) -> Column:
    return F.from_json(text, CIPHER)


def _fold(schema: T.StructType, keys: int, key: PublicKey, raise_to_weight: bool, bits: int = SCALE_BITS):
    """Multiply ciphertexts of equal groups in sorted input, one open group at a time.

    Ciphertexts of one weight are multiplied first and raised to it together: a group costs a power per distinct weight, not per row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, square = to_arrow_schema(schema), key.n * key.n
        open_group, total = None, 0
        products: dict[int, int] = {}  # of the open group, by the power they still need
        done: list[tuple] = []

        def raised() -> int:
            product = 1
            for power, c in products.items():
                product = product * pow(c, power, square) % square
            products.clear()
            return product

        for batch in batches:
            *groups, ciphers, weights = batch.columns
            columns = [*[c.to_pylist() for c in groups], _numbers(ciphers, bits), weights.to_pylist()]
            for *group, c, weight in zip(*columns, strict=True):
                if group != open_group:
                    if open_group is not None:
                        done.append((*open_group, raised(), total))
                    open_group, total = group, 0
                power = weight if raise_to_weight else 1
                held = products.get(power)
                products[power] = c if held is None else held * c % square
                total += weight
                if len(products) > OPEN_WEIGHTS:
                    products[1] = raised()
                if len(done) >= OUT_ROWS:
                    yield _batch(done, arrow, bits)
                    done = []
        if open_group is not None:
            done.append((*open_group, raised(), total))
        if done:
            yield _batch(done, arrow, bits)

    return run


def _batch(rows: list[tuple], schema: pa.Schema, bits: int) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[-2] = [{"ciphertext": str(c), "exponent": -bits} for c in columns[-2]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _numbers(ciphers: pa.StructArray, bits: int = SCALE_BITS) -> list[int | None]:
    """The ciphertexts of a column; None where there is none."""
    texts, exponents = ciphers.flatten()
    present = ciphers.is_valid()
    odd = [e for e in exponents.filter(present).unique().to_pylist() if e != -bits]
    if odd:
        raise ValueError(f"unexpected exponent {odd[0]}")
    if texts.filter(present).null_count:
        raise ValueError("a ciphertext without its number")
    return [None if t is None else int(t) for t in texts.to_pylist()]


def _lists(column: pa.ListArray) -> list[list]:
    """As ``to_pylist`` of lists that are not NULL, without an object per element."""
    flat = column.flatten()
    flat, out, at = flat.to_pylist() if flat.null_count else flat.to_numpy(zero_copy_only=False).tolist(), [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def _replace(schema: T.StructType, old: str, field: T.StructField) -> T.StructType:
    return T.StructType([field if f.name == old else f for f in schema.fields])
