"""Column types of every table the package reads or writes, as DDL text."""

from __future__ import annotations

# Star-schema and event tables, as stored on disk.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# One message-queue record, as the stream source hands it over.
QUEUE_RECORD = (
    "key binary, value binary, topic string, partition int, offset bigint, "
    "timestamp timestamp, timestampType int"
)

BRONZE = (
    "kafka_topic string, source_id string, source_name string, partition int, offset bigint, "
    "kafka_timestamp timestamp, ingestion_timestamp string, processed_timestamp timestamp, "
    "raw_data map<string,string>, is_valid boolean, quality_score int, "
    "source_type string, ingestion_date date, ingestion_hour int, query_id string, batch_id bigint"
)

DEAD_LETTER = (
    "original_message string, error struct<type:string,message:string,traceback:string>, "
    "source string, timestamp timestamp, retry_count int, metadata map<string,string>, queue string"
)

LINEAGE_EVENT = (
    "event_type string, timestamp timestamp, job_name string, "
    "source struct<layer:string,name:string,type:string,tables:array<string>>, "
    "destination struct<layer:string,table:string,path:string>, transformation_type string, "
    "row_count_in bigint, row_count_out bigint, data_loss_percentage double, "
    "status string, duration_seconds double, error string, metadata map<string,string>"
)

METRIC_SAMPLE = "name string, type string, value double, labels map<string,string>, help string, timestamp bigint"

PIPELINE_RUN = (
    "run_id string, dag_id string, pipeline_name string, started_at timestamp, ended_at timestamp, "
    "duration_seconds double, status string, error_message string, retry_count int"
)

SOURCE_EXECUTION = (
    "execution_id string, source_id string, pipeline_run_id string, source_name string, "
    "started_at timestamp, ended_at timestamp, extracted_record_count bigint, "
    "validated_record_count bigint, failed_record_count bigint, published_record_count bigint, "
    "quality_score double, status string, error_message string"
)

DEMO_EVENT = (
    "event_id string, event_name string, destination string, visitor_count int, revenue double, "
    "event_date timestamp"
)

# Typed projections of the external-data payload, keyed by data_type.
WEATHER = (
    "current struct<temp:double,feels_like:double,humidity:int,pressure:int,wind_speed:double,"
    "weather:string,icon:string>, "
    "forecast array<struct<date:string,temp_min:double,temp_max:double,precipitation:double,weather:string>>"
)
PLACE = "place_id string, name string, category string, rating double, address string"
SOCIAL = (
    "post_id string, author string, text string, sentiment string, "
    "engagement struct<likes:bigint,shares:bigint,comments:bigint>"
)
EXTERNAL = (
    "source string, data_type string, "
    "location struct<city:string,country:string,lat:double,lon:double>, "
    "timestamp string, data string, metadata map<string,string>"
)

CLICKSTREAM = (
    "anonymous_id string, user_id bigint, event string, "
    "properties struct<page:string,title:string,url:string,path:string,referrer:string,"
    "search:string,duration:double>, "
    "context struct<ip:string,user_agent:string,locale:string,timezone:string,"
    "screen:struct<width:int,height:int>,"
    "campaign:struct<name:string,source:string,medium:string,term:string,content:string>>, "
    "timestamp string, received_at string"
)

CHANGE_EVENT = (
    "payload struct<before:map<string,string>,after:map<string,string>,"
    "source:struct<version:string,connector:string,name:string,ts_ms:bigint,db:string,"
    "schema:string,table:string,snapshot:string>,op:string,ts_ms:bigint>"
)
