"""Snapshot comparison: orders against a derived second snapshot, documents as an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import snapshot
from parcelwise.plans.base import Registry, table
from parcelwise.sources import receipts

R = Registry()
QUERIES, SQL = R.queries, R.sql


def old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey")
    new = o.where(k % 31 != 0).withColumn(
        "o_totalprice", F.when(k % 7 == 0, F.col("o_totalprice") + 10).when(k % 11 == 0, F.col("o_totalprice") + 0.004).otherwise(F.col("o_totalprice"))
    ).withColumn("o_orderstatus", F.when(k % 17 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.where(k % 29 != 0), new


_SNAP = """
    old as (select o_orderkey, o_totalprice, o_orderstatus, o_custkey from orders where o_orderkey % 29 <> 0),
    new as (select o_orderkey, o_totalprice + case when o_orderkey % 7 = 0 then 10 when o_orderkey % 11 = 0 then 0.004::double else 0 end as o_totalprice,
                   case when o_orderkey % 17 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_orderkey % 31 <> 0),
    both_sides as (select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, o.o_totalprice as old, n.o_totalprice as new, o.o_orderstatus as ol, n.o_orderstatus as nl
             from old o full join new n on o.o_orderkey = n.o_orderkey)"""


@R.add("q_snapshot_diff", f"""with {_SNAP}
    select o_orderkey, old, new, case when old is null then 'added' when new is null then 'removed' else 'updated' end as change,
           case when old is not null and new is not null then round(new - old, 4) end as delta
    from both_sides where old is null or new is null or abs(old - new) > 0.005""")
def _(spark, sf):
    old, new = old_new(spark, sf)
    return snapshot.number_changes(old, new, "o_orderkey", "o_totalprice")


@R.add("q_snapshot_report", f"""with {_SNAP}
    select o_orderkey, case when old is null then 'added' when new is null then 'removed' else 'updated' end as change
    from both_sides where old is null or new is null or abs(old - new) > 0.005 order by o_orderkey limit 50""")
def _(spark, sf):
    old, new = old_new(spark, sf)
    return snapshot.number_changes(old, new, "o_orderkey", "o_totalprice", limit=50).select("o_orderkey", "change")


@R.add("q_comparison_diff", f"""with {_SNAP}
    select o_orderkey, case when old is null then 'added' when new is null then 'removed' else 'updated' end as change, ol as old_label, nl as new_label,
           case when abs(old - new) > 0.005 then round(new - old, 4) end as delta
    from both_sides where old is null or new is null or abs(old - new) > 0.005 or ol <> nl""")
def _(spark, sf):
    old, new = old_new(spark, sf)
    return snapshot.comparison_changes(old, new, "o_orderkey", "o_totalprice", "o_orderstatus").select(
        "o_orderkey", "change", "old_label", "new_label", "delta")


@R.add("q_pair_diff", f"""with {_SNAP}
    select *, 'added' as change from (select o_custkey, o_orderstatus from new except select o_custkey, o_orderstatus from old)
    union all select *, 'removed' from (select o_custkey, o_orderstatus from old except select o_custkey, o_orderstatus from new)""")
def _(spark, sf):
    old, new = old_new(spark, sf)
    return snapshot.pair_changes(old.select("o_custkey", "o_orderstatus"), new.select("o_custkey", "o_orderstatus"))


@R.add("q_field_diff", f"""with {_SNAP}, a as (select count(*)::varchar as n, max(o_orderkey)::varchar as top, min(o_custkey)::varchar as low from old),
    b as (select count(*)::varchar as n, max(o_orderkey)::varchar as top, min(o_custkey)::varchar as low from new)
    select * from (select 'n' as field, a.n as old, b.n as new from a, b union all select 'top', a.top, b.top from a, b
                   union all select 'low', a.low, b.low from a, b) where old is distinct from new""")
def _(spark, sf):
    aggs = [F.count("*").alias("n"), F.max("o_orderkey").alias("top"), F.min("o_custkey").alias("low")]
    old, new = old_new(spark, sf)
    return snapshot.field_changes(old.agg(*aggs), new.agg(*aggs))


def inventories(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.concat(F.col("source"), F.lit("/"), F.when(k % 40 == 0, F.concat(k.cast("string"), F.lit("/status.json"))).otherwise(F.concat(k.cast("string"), F.lit(".txt"))))
    base = d.select(k, path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("byte_length"))
    changed = base.where(k % 9 != 0).withColumn("sha256", F.when(k % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).withColumn(
        "byte_length", F.when(k % 14 == 0, F.col("byte_length") + 1).otherwise(F.col("byte_length")))
    return base.where(k % 10 != 0).drop("doc_id"), changed.drop("doc_id")


_INV = """
    base as (select doc_id as k, source || '/' || case when doc_id % 40 = 0 then doc_id || '/status.json' else doc_id || '.txt' end as path, sha256(text) as sha256,
                    octet_length(encode(text)) as byte_length from documents),
    man as (select * from base where k % 10 <> 0),
    act as (select k, path, case when k % 7 = 0 then sha256(sha256) else sha256 end as sha256, byte_length + case when k % 14 = 0 then 1 else 0 end as byte_length from base where k % 9 <> 0)"""


@R.add("q_inventory_diff", f"""with {_INV}
    select coalesce(m.path, a.path) as path, m.sha256 as old_sha256, a.sha256 as new_sha256,
           case when m.path is null then 'added' when a.path is null then 'removed' else 'updated' end as change
    from man m full join act a on m.path = a.path where m.sha256 is distinct from a.sha256""")
def _(spark, sf):
    return snapshot.inventory_changes(*inventories(spark, sf))


@R.add("q_inventory_verify", f"""with {_INV}, j as (select coalesce(m.path, a.path) as path, m.path as mp, a.path as ap, m.sha256 as ms, a.sha256 as s, m.byte_length as ml, a.byte_length as al
        from man m full join act a on m.path = a.path)
    select path, 'missing' as problem from j where ap is null union all select path, 'checksum mismatch' from j where ms <> s
    union all select path, 'byte_length mismatch' from j where ml <> al union all select path, 'untracked' from j where mp is null and path not like '%/status.json'""")
def _(spark, sf):
    return snapshot.verify_inventory(*inventories(spark, sf))


_DIGEST = """select count(*) as n, sha256(concat_ws('-', count(*)::varchar, sum(('0x' || h[1:16])::ubigint::hugeint)::varchar, sum(('0x' || h[17:32])::ubigint::hugeint)::varchar,
      sum(('0x' || h[33:48])::ubigint::hugeint)::varchar, sum(('0x' || h[49:64])::ubigint::hugeint)::varchar)) as digest"""


@R.add("q_digest", f"""with {_INV}, lines as (select sha256(path || chr(31) || sha256 || chr(31) || byte_length) as h from man where path not like '%/status.json')
    {_DIGEST} from lines""")
def _(spark, sf):
    return snapshot.inventory_digest(inventories(spark, sf)[0])


@R.add("q_table_digest", f"""with lines as (select sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) as h from orders)
    select digest, '2024-05-01T120000Z-' || digest[1:7] as snapshot_id from ({_DIGEST} from lines)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = snapshot.digest(o, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"))
    return d.select("digest", snapshot.snapshot_id(F.lit("2024-05-01 12:00:00").cast("timestamp"), F.col("digest")).alias("snapshot_id"))


@R.add("q_row_ids", """
    select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || case when doc_id % 10 = 0 then 'null' else '"' || lang || '"' end || ',"source":"' || source || '"}') as row_id
    from documents""")
def _(spark, sf):
    # every tenth document has no language; the names are given out of order
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("lang"), "source")
    return snapshot.row_ids(d, ["source", "doc_id", "lang"]).select("doc_id", "row_id")


@R.add("q_review_union", """
    select 'orders' as layer, o_orderkey as id, o_orderstatus as status, null::double as balance from orders where o_totalprice > 400000
    union all select 'customer', c_custkey, null, c_acctbal from customer where c_acctbal < 0""")
def _(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return snapshot.tagged_union({"orders": a, "customer": b})


@R.add("q_file_inventory", f"""with {_INV}
    select 'documents' as source_id, path, sha256, byte_length, strftime(timestamp '2024-05-01 12:00:00', '%Y-%m-%d %H:%M:%S') as retrieved_at from man""")
def _(spark, sf):
    files = receipts.receipts(inventories(spark, sf)[0], "documents", "2024-05-01 12:00:00")
    return files.withColumn("retrieved_at", F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss"))


@R.add("q_pin_gate", f"""with {_INV}
    select m.path, m.sha256 as expected, a.sha256 as actual, coalesce(m.sha256 = a.sha256, false) as ok from man m left join act a on m.path = a.path""")
def _(spark, sf):
    pins, files = inventories(spark, sf)
    return receipts.pin_gate(files, pins)
