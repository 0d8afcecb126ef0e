import pytest
from pyspark.sql import functions as F

from opsweave.functions import text
from opsweave.functions.text import HOST_MASKS, POD_MASKS, line_severity, masked, short_hash
from opsweave.operators import logs


def mask(spark, line, masks=HOST_MASKS):
    df = spark.createDataFrame([(line,)], "l string")
    return df.select(masked(F.col("l"), masks)).first()[0]


def test_masks(spark):
    assert mask(spark, "Connection from 192.168.1.1 refused") == "Connection from <IP> refused"
    assert mask(spark, "id 123e4567-e89b-12d3-a456-426614174000 gone") == "id <UUID> gone"
    assert mask(spark, "Process 12345 used 98765 bytes") == "Process <NUM> used <NUM> bytes"
    assert mask(spark, "address 0xdeadbeef01 fault") == "address <HEX> fault"
    assert mask(spark, "port 80 of 10.0.0.1:8080", POD_MASKS) == "port <N> of <IP>"


def test_same_template_same_hash(spark):
    df = spark.createDataFrame([("error at 192.168.1.1 port 8080",), ("error at 10.0.0.1 port 9090",)], "l string")
    assert df.select(short_hash(masked(F.col("l"), HOST_MASKS))).distinct().count() == 1


@pytest.mark.parametrize(
    "line, severity",
    [
        ("", None), ("x" * 9000 + " ERROR", None), ("DEBUG error", None), ("GET /healthz ERROR", None),
        ("goroutine PANIC now", "FATAL"), ("fatal lower", None), ("an error: here", "ERROR"), ("WARNING x", "WARN"),
        ("pod OOMKilled", "WARN"), ("status 503 ", "WARN"), ("all fine", None), ("éERROR", None),
    ],
)
def test_severity(spark, line, severity):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(line_severity(F.col("l"))).first()[0] == severity


def test_severity_is_found_once(spark):
    """Patterns stand in the plan once; a filter on the severity would be moved below it and repeat them."""
    lines = spark.createDataFrame([("n", "p", 1.0, "x")], "namespace string, pod string, ts double, line string")
    plan = logs.classify_pod_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("healthz") == 1


def test_patterns_know_every_first_letter(spark):
    """What is asked for before a word boundary leaves no match out, other Unicode forms of a letter included."""
    words = ("debug trace healthz readyz livez error err exception traceback warn warning oomkilled crashloopbackoff imagepullbackoff enoent "
             "eacces timeout segfault keyerror valueerror runtimeerror nullpointerexception").split()
    forms = {"s": "\u017f", "k": "\u212a", "i": "\u0131"}
    made = [f(w) for w in words for f in (str, str.upper, str.title, lambda w: forms.get(w[0], w[0]) + w[1:], lambda w: "x" + w, lambda w: "\u00e9" + w)]
    made += ["/metrics ", "panic: x", "FATAL", "PANIC", "503 ", "dial tcp", "no such file", "\u0130magepullbackoff", "error: x"]
    df = spark.createDataFrame([(w,) for w in made], "line string")
    for pattern in (text.DROP, text.FATAL, text.ERROR, text.WARN, text.HIGH_SIGNAL):
        assert pattern.startswith("(?=[")
        plain = pattern[pattern.index("])") + 2 :]
        assert df.where(F.col("line").rlike(pattern) != F.col("line").rlike(plain)).count() == 0
