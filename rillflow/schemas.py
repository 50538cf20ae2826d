"""Named, typed columns of the domain streams."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[k]) for n, k in (x.split() for x in text.split(","))])


BID = _schema("auction long,bidder long,price long,date_time long,extra string")
AUCTION = _schema("id long,item_name string,description string,initial_bid long,reserve long,date_time long,expires long,seller long,category long,extra string")
PERSON = _schema("id long,name string,email string,credit_card string,city string,state string,date_time long,extra string")
CLOSED_AUCTION = _schema("id long,seller_id long,final_price long,category long,date_time long,extra string")
TAXI_TRIP = _schema(
    "medallion string,hack_license string,vendor_id string,rate_code long,store_and_fwd_flag string,pickup_datetime long,dropoff_datetime long,"
    "passenger_count long,trip_time_secs long,trip_distance double,pickup_longitude double,pickup_latitude double,dropoff_longitude double,dropoff_latitude double"
)
ROUTE_INFO = T.StructType([*TAXI_TRIP.fields, *_schema("start_cell_id long,end_cell_id long,route_id long").fields])
TWITCH_EVENT = _schema("user_id string,streamer_id string,streamer_name string,event_time long,event_type string")
TASK_EVENT = _schema(
    "timestamp long,missing_info string,job_id long,task_index long,machine_id long,event_type string,user_name string,scheduling_class long,priority long,"
    "cpu_request double,ram_request double,local_disk_request double,constraint boolean"
)
AZURE_EVENT = _schema("timestamp long,vm_id string,min_cpu double,max_cpu double,avg_cpu double")
