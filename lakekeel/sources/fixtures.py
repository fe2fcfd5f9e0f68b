"""Domain tables derived from the test tables, with one SQL text for Spark and DuckDB (see FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "pings": """
select user_id as worker_id,
       case event_type when 'click' then '2.13.0' when 'view' then '2.9.0' when 'signup' then '3.0.0'
                       when 'purchase' then '2.10.1-rc1' else 'bad' end as version,
       cast(floor(value*100) as bigint) as stored_bytes, ts, event_id,
       case when event_id % 11 = 0 then null else cast(58100 + event_id % 40 as int) end as current_epoch,
       cast(event_id % 60 as int) as applied_id
from events""",
    "chunks_raw": """
select concat('s3://ds-', cast(l_suppkey % 10 as string)) as dataset,
       l_orderkey*8+l_linenumber as first_block,
       l_orderkey*8+l_linenumber+cast(l_quantity as bigint)%5 as last_block,
       cast(floor(l_extendedprice) as bigint) as size, l_partkey, cast(l_quantity as bigint) as q
from lineitem""",
    "chunks": """
select o_orderkey as chunk_pk, concat('s3://ds-', cast(o_custkey % 10 as string)) as dataset,
       o_orderkey*100 as first_block, o_orderkey*100+99 as last_block,
       cast(floor(o_totalprice) as bigint) as size,
       case substr(o_orderpriority,1,1) when '1' then 12 when '2' then 6 when '3' then 2 else 1 end as weight
from orders""",
    "workers": """
select s_suppkey as worker_pk, s_name as peer_id,
       case s_nationkey % 4 when 0 then '2.9.0' when 1 then '2.13.0' when 2 then '3.0.0' else null end as version,
       case when s_suppkey % 13 = 0 then cast(40 as bigint) end as inactive_since
from supplier""",
    "holders_before": """
select c.chunk_pk, (c.chunk_pk*7 + r.k*31) % 100 as worker_pk
from chunks c cross join (select * from (values (0),(1),(2)) t(k)) r
where r.k < 2 or c.weight > 1""",
    "holders_after": """
select c.chunk_pk, (c.chunk_pk*7 + r.k*31 + case when c.chunk_pk % 5 = 0 then 3 else 0 end) % 100 as worker_pk
from chunks c cross join (select * from (values (0),(1),(2),(3)) t(k)) r
where c.chunk_pk % 17 <> 0 and (r.k < 2 or c.weight > 2)""",
    "stale": """
select b.chunk_pk, b.worker_pk, cast(1 + b.chunk_pk % 6 as int) as superseded_at
from holders_before b left join holders_after a on a.chunk_pk=b.chunk_pk and a.worker_pk=b.worker_pk
where a.chunk_pk is null""",
    "meta": """
select chunk_pk, chunk_pk % 23 = 0 as rejected,
       case when chunk_pk % 23 <> 0 and chunk_pk % 3 <> 0 then cast(1 + chunk_pk % 6 as int) end as applied_worker,
       case when chunk_pk % 23 <> 0 and chunk_pk % 3 = 1 then cast(1 + chunk_pk % 4 as int) end as applied_portal,
       case when chunk_pk % 19 = 0 then cast(20 as bigint) end as marked,
       case when chunk_pk % 38 = 0 then cast(3 as int) end as dropped_portal,
       case when chunk_pk % 76 = 0 then cast(30 as bigint) end as dropped_worker
from chunks where chunk_pk % 29 <> 0""",
    "portal_log": """
select cast(k as int) as id, cast(k*10 as bigint) as created_at, cast(k as int) as confirmed_up_to
from (values (1),(2),(3),(4),(5),(6)) t(k)""",
    "corrections": """
select chunk_pk as old_pk, chunk_pk+1 as new_pk,
       case when chunk_pk % 10 = 1 then cast(2 as int) end as applied_portal
from chunks where chunk_pk % 10 in (1,2,3)""",
    "difflog": """
select cast(e % 7 + 1 as int) as assignment_id, chunk_pk,
       case when (chunk_pk + e) % 6 = 0 then null else (chunk_pk + e) % 100 end as worker_pk
from (select chunk_pk, k as e from chunks cross join (values (0),(2),(5)) t(k)) x""",
    "objects": """
select concat(dataset,'/',lpad(cast(first_block as string),10,'0'),'-',lpad(cast(last_block as string),10,'0')) as prefix,
       f.file as file_name, size + f.n as size, dataset
from chunks cross join (select * from (values ('blocks.parquet',0),('logs.parquet',1),('transactions.parquet',2)) t(file,n)) f
where not (chunk_pk % 41 = 0 and f.n = 0)""",
    "schemas": """
select cast(p_partkey as int) as schema_id, p_brand as dataset, p_type as table_name, cast(p_size as int) as n_fields from part""",
    "segments": """
select * from (values ('s3://ds-0',cast(0 as bigint),1),('s3://ds-0',cast(500000 as bigint),6),
                      ('s3://ds-0',cast(-200000 as bigint),12),('s3://ds-1',cast(300000 as bigint),2)) t(dataset,seg_from,weight)""",
    "blocks": """
select concat('c-', cast(l_orderkey % 500 as string)) as chunk, l_orderkey*8+l_linenumber as number,
       md5(concat(cast(l_orderkey as string),'-',cast(l_partkey as string))) as hash, l_partkey as ts_s
from lineitem""",
}


def needed(sql: str) -> list[str]:
    """The views that a text uses, those they use first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def oracle(sql: str) -> str:
    """The SQL with the views it needs in front, for DuckDB."""
    views = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in needed(sql))
    text = sql.strip()
    if not views:
        return text
    if text.lower().startswith("with recursive"):
        return f"with recursive {views}, {text[len('with recursive') :].strip()}"
    if text.lower().startswith("with "):
        return f"with {views}, {text[5:].strip()}"
    return f"with {views} {text}"


class Fixtures:
    """The views as DataFrames over one folder of test tables: fixtures.chunks, fixtures.pings, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        inputs = {t: self.__getattr__(t) for t in (*TABLES, *VIEWS) if t != name and re.search(rf"\b(from|join)\s+{t}\b", text)}
        for t in inputs:
            text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
        return self._spark.sql(text, **inputs)
