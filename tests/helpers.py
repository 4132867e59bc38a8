import datetime as dt

from cubeline.model import CubeDef, EventSource, Report
from cubeline.plans.engine import Engine

EVENT = "uuid string, source_id string, event_type string, ts timestamp, attributions array<struct<type:string,value:string>>, payload struct<{}>"


def events(spark, fields, rows, source="src", kind="test_event"):
    """rows: (ts, payload tuple[, attributions[, event type]])"""
    made = []
    for n, r in enumerate(rows):
        who = [{"type": k, "value": v} for k, v in (r[2] if len(r) > 2 and r[2] else ())]
        made.append((f"{source}-{n}", source, r[3] if len(r) > 3 else kind, r[0], who, tuple(r[1])))
    return spark.createDataFrame(made, EVENT.format(fields))


def engine(spark, path, *, cubes=(("c", "minute"),), sources=("src",), kinds=("test_event",), **kw):
    e = Engine(spark, str(path), **kw)
    for s in sources:
        e.registry.create_source(EventSource(s))
        for k in kinds:
            e.registry.create_event_type(s, k)
    e.registry.create_report(Report("r"))
    for name, g in cubes:
        e.registry.create_cube(CubeDef("r", name, g))
    return e


def t(text):
    return dt.datetime.fromisoformat(text)
