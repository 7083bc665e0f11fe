"""Realtime feeds: messages of the public GTFS-realtime schema decoded, and a stream that polls a URL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from headway import schemas
from headway.errors import FeedError

#: Messages of the public schema, as field number, name, type (a message's name, or a kind) and
#: whether it repeats; fields that nothing here reads are left out, and decoding skips them.
MESSAGES = {
    "FeedMessage": ((1, "header", "FeedHeader", False), (2, "entity", "FeedEntity", True)),
    "FeedHeader": ((1, "gtfs_realtime_version", "string", False), (3, "timestamp", "uint64", False)),
    "FeedEntity": ((1, "id", "string", False), (2, "is_deleted", "bool", False), (3, "trip_update", "TripUpdate", False), (5, "alert", "Alert", False)),
    "TripUpdate": ((1, "trip", "TripDescriptor", False), (2, "stop_time_update", "StopTimeUpdate", True), (4, "timestamp", "uint64", False)),
    "TripDescriptor": ((1, "trip_id", "string", False), (3, "start_date", "string", False), (4, "schedule_relationship", "int32", False), (5, "route_id", "string", False)),
    "StopTimeUpdate": ((1, "stop_sequence", "uint32", False), (2, "arrival", "StopTimeEvent", False), (3, "departure", "StopTimeEvent", False), (4, "stop_id", "string", False), (5, "schedule_relationship", "int32", False)),
    "StopTimeEvent": ((1, "delay", "int32", False), (2, "time", "int64", False)),
    "Alert": (
        (1, "active_period", "TimeRange", True), (5, "informed_entity", "EntitySelector", True), (6, "cause", "int32", False), (7, "effect", "int32", False),
        (8, "url", "TranslatedString", False), (10, "header_text", "TranslatedString", False), (11, "description_text", "TranslatedString", False), (14, "severity_level", "int32", False),
    ),
    "TimeRange": ((1, "start", "uint64", False), (2, "end", "uint64", False)),
    "EntitySelector": ((2, "route_id", "string", False), (5, "stop_id", "string", False), (6, "direction_id", "uint32", False)),
    "TranslatedString": ((1, "translation", "Translation", True),),
    "Translation": ((1, "text", "string", False), (2, "language", "string", False)),
}


@cache
def message(name: str = "FeedMessage"):
    """The message class of the schema, built from MESSAGES."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    proto = descriptor_pb2.FileDescriptorProto(name="headway_realtime.proto", package="headway", syntax="proto2")
    kinds = descriptor_pb2.FieldDescriptorProto
    for title, fields in MESSAGES.items():
        m = proto.message_type.add(name=title)
        for number, field, kind, repeats in fields:
            f = m.field.add(name=field, number=number, label=kinds.LABEL_REPEATED if repeats else kinds.LABEL_OPTIONAL)
            if kind in MESSAGES:
                f.type, f.type_name = kinds.TYPE_MESSAGE, f".headway.{kind}"
            else:
                f.type = getattr(kinds, f"TYPE_{kind.upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(proto)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"headway.{name}"))


def _value(m, field: str):
    return getattr(m, field) if m.HasField(field) else None


def _event(m, field: str) -> dict | None:
    if not m.HasField(field):
        return None
    e = getattr(m, field)
    return {"delay": _value(e, "delay"), "time": _value(e, "time")}


def _texts(m, field: str) -> list[dict]:
    return [{"language": _value(t, "language"), "text": t.text} for t in getattr(m, field).translation]


def decode(raw: bytes) -> tuple[list[dict], list[dict]]:
    """Trip updates and alerts of one feed message, as rows of the feed schemas."""
    from google.protobuf.message import DecodeError

    try:
        feed = message().FromString(raw)
    except DecodeError as e:
        raise FeedError(f"not a feed message: {e}") from e
    updates, alerts = [], []
    for e in feed.entity:
        if e.HasField("trip_update"):
            t = e.trip_update.trip
            stops = [
                {"stop_id": s.stop_id, "stop_sequence": _value(s, "stop_sequence"), "relationship": _value(s, "schedule_relationship"), "arrival": _event(s, "arrival"), "departure": _event(s, "departure")}
                for s in e.trip_update.stop_time_update
            ]
            updates.append({"id": e.id, "trip": {"trip_id": t.trip_id, "route_id": t.route_id, "start_date": _value(t, "start_date"), "relationship": _value(t, "schedule_relationship")}, "stop_time_update": stops})
        if e.HasField("alert"):
            a = e.alert
            alerts.append(
                {
                    "id": e.id, "cause": _value(a, "cause"), "effect": _value(a, "effect"), "severity": _value(a, "severity_level"),
                    "header": _texts(a, "header_text"), "description": _texts(a, "description_text"), "url": _texts(a, "url"),
                    "informed_entity": [{"route_id": _value(x, "route_id"), "direction_id": _value(x, "direction_id"), "stop_id": _value(x, "stop_id")} for x in a.informed_entity],
                    "active_period": [{"start": _value(p, "start"), "end": _value(p, "end")} for p in a.active_period],
                }
            )
    return updates, alerts


def decoded(messages: DataFrame, kind: str, raw: str = "raw", poll_time: str = "poll_time") -> DataFrame:
    """A row for each ``trip_update`` or ``alert`` of a table or stream of raw messages, with its poll time."""
    which = {"trip_update": 0, "alert": 1}[kind]
    schema = {"trip_update": schemas.TRIP_UPDATE, "alert": schemas.ALERT}[kind]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [x | {"poll_time": t} for t, b in zip(pdf[poll_time], pdf[raw], strict=True) for x in decode(bytes(b))[which]]
            if rows:
                yield pd.DataFrame(rows, dtype=object)

    return messages.select(F.col(poll_time).alias(poll_time), F.col(raw).alias(raw)).mapInPandas(run, f"{schema}, poll_time timestamp")


class PolledFeed(DataSource):
    """``spark.readStream.format("headway_feed")``: a row (poll_time, raw, status) for each poll of ``url``.

    Options: url, and header_<name> for each header sent.  A poll that fails gives a row without a message
    whose status says why, so the stream goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "headway_feed"

    def schema(self) -> str:
        return "poll_time timestamp, raw binary, status string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _Poller(self.options)


class _Poller(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.url = options["url"]
        self.headers = {k.removeprefix("header_"): v for k, v in options.items() if k.startswith("header_")}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polls": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import urllib.request

        now = dt.datetime.now(dt.timezone.utc)
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers=self.headers), timeout=30) as r:
                row = (now, r.read(), "ok")
        except (OSError, ValueError) as e:
            row = (now, None, f"error: {e}")
        return iter([row]), {"polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A poll that was lost with its batch can't be had again."""
        return iter([])
