"""Left joins with a table of unique keys, of which some may belong to a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more rows than this are looked up apart; there is one at most in so many rows.
HOT = 500
#: Tables of up to so many rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts of a hot key's rows where hot keys are too many to be sent.
SALT = 64


def look_up(rows: DataFrame, table: DataFrame, key: str, own: str, n: str, salt_by: str) -> DataFrame:
    """rows with the columns of table but own and n, null where no key is equal.

    key: column of rows. table: own (unique keys), n (about how many rows have the key),
    others. salt_by: a column of rows that tells rows of one key apart. Each way gives
    the same rows; the sizes choose between them.
    """
    on = F.col(key) == F.col(own)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(n)), on, "left").drop(own)
    hot, cold = table.where(F.col(n) > HOT).drop(n), table.where(F.col(n) <= HOT).drop(n)
    some = hot.count()
    if not some:
        return rows.join(cold, on, "left").drop(own)
    if some <= BROADCAST_ROWS:
        few = rows.join(F.broadcast(hot), on).drop(own)
        rest = rows.join(F.broadcast(hot.select(own)), on, "left_anti")
    else:
        on_salted = on & (F.col("docloom_part") == F.col("docloom_salt"))
        salted = hot.withColumn("docloom_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        mine = rows.withColumn("docloom_part", F.pmod(F.xxhash64(salt_by), F.lit(SALT)).cast("int"))
        few = mine.join(salted, on_salted).drop(own, "docloom_part", "docloom_salt")
        rest = mine.join(salted.select(own, "docloom_salt"), on_salted, "left_anti").drop("docloom_part")
    return few.unionByName(rest.join(cold, on, "left").drop(own))
