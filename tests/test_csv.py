from pathlib import Path

import pytest

from pulsegrid.errors import InvalidArgument
from pulsegrid.sources.csv_records import order_rows, read_csv_records, read_metric_rows


def write(folder, text, name="data.csv"):
    path = Path(folder) / name
    path.write_bytes(text.encode())
    return str(path)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_header_only(spark, folder):
    df = read_csv_records(spark, write(folder, "gpu_id,power,temp\n"))
    assert df.columns == ["gpu_id", "power", "temp"] and rows(df) == []


def test_cells_stay_strings(spark, folder):
    df = read_csv_records(spark, write(folder, "gpu_id,power,temp\ngpu-1,250,75\n"))
    assert rows(df) == [{"gpu_id": "gpu-1", "power": "250", "temp": "75"}]


def test_file_order(spark, folder):
    text = "gpu_id,power\n" + "".join(f"gpu-{i},{i}00\n" for i in range(200))
    df = read_csv_records(spark, write(folder, text), arrival=True).orderBy("arrival")
    assert [r["gpu_id"] for r in rows(df)] == [f"gpu-{i}" for i in range(200)]


def test_quotes_commas_and_line_breaks(spark, folder):
    text = 'gpu_id,description\r\ngpu-1,"Low Power GPU, Energy Efficient"\r\ngpu-2,"a ""b"""\r\ngpu-3,"two\r\nlines"\r\n'
    assert [r["description"] for r in rows(read_csv_records(spark, write(folder, text)))] == [
        "Low Power GPU, Energy Efficient",
        'a "b"',
        "two\nlines",
    ]


def test_empty_cells_are_empty_strings(spark, folder):
    assert rows(read_csv_records(spark, write(folder, 'a,b,c\n,"",x\n'))) == [{"a": "", "b": "", "c": "x"}]


@pytest.mark.parametrize("row", ["gpu-1", "gpu-1,2,3"])
def test_ragged_row_fails_whatever_is_selected(spark, folder, row):
    df = read_csv_records(spark, write(folder, f"gpu_id,power\ngpu-0,1\n{row}\n"))
    with pytest.raises(Exception):
        df.collect()
    with pytest.raises(Exception):
        df.select("gpu_id").collect()


def test_missing_file(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv_records(spark, folder + "/none.csv")


def test_zero_byte_file(spark, folder):
    df = read_csv_records(spark, write(folder, ""))
    assert df.columns == [] and df.count() == 0


def test_repeated_header_keeps_last(spark, folder):
    df = read_csv_records(spark, write(folder, "a,b,a\n1,2,3\n"))
    assert rows(df) == [{"b": "2", "a": "3"}]


def test_headers_that_differ_in_case(spark, folder):
    with pytest.raises(InvalidArgument):
        read_csv_records(spark, write(folder, "pod,Pod\n1,2\n"))


def test_header_mismatch_between_files(spark, folder):
    write(folder, "a,b\n1,2\n", "1.csv")
    write(folder, "b,a\n1,2\n", "2.csv")
    with pytest.raises(Exception):
        read_csv_records(spark, folder).collect()


def test_metric_rows(spark, folder):
    header = "timestamp,metric_name,gpu_id,device,uuid,modelName,Hostname,container,pod,namespace,value,labels_raw\n"
    good = '2026-04-10T15:00:00Z,DCGM_FI_DEV_GPU_UTIL,0,nvidia0,GPU-1,H100,host-1,,,,45,"a=""b"",c=d"\n'
    bad = "later,DCGM_FI_DEV_GPU_UTIL,0,nvidia0,GPU-1,H100,host-1,,,,n/a,\n"
    first, second = read_metric_rows(spark, write(folder, header + good + bad)).collect()
    assert first["value"] == 45.0 and first["timestamp"] is not None and first["container"] == ""
    assert first["labels_raw"] == 'a="b",c=d'
    assert second["value"] is None and second["timestamp"] is None


def test_order_rows_without_source(spark):
    df = order_rows(spark.range(100).coalesce(1))
    assert [r["id"] for r in df.orderBy("arrival").collect()] == list(range(100))


ODD = [
    'gpu_id,description,n\n',
    'a,"two\nlines",1\n', 'b,"three\n\nlines ""x"", y",2\n', 'd,"",4\n', '\n', '\n', 'e,"q""",""""\n', 'f,,\n',
    '"g","a,b\n\n\nc","7"\n', 'h,"""\n""",8\n', 'i,é ü 日本,"9\n"\n', '"j\n",x,10\n', 'k,"long\n' + "line, \"\"of\"\" text\n" * 40 + 'end",11\n',
]


@pytest.fixture
def small_splits(spark):
    """Files cut every ``size`` bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def cut(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [30, 400])
def test_split_files_read_the_same(spark, folder, small_splits, size):
    import random

    names = []
    for f in range(3):
        body = ODD[1:] * 2
        random.Random(f).shuffle(body)
        text = ODD[0] + "".join(body) + ("z,last,0" if f else "")
        names.append(write(folder, text.replace("\n", "\r\n") if f == 1 else text, f"part-{f}.csv"))
    whole = sorted(map(tuple, read_csv_records(spark, folder, multi_line=True).collect()))
    small_splits(size)
    df = read_csv_records(spark, folder, arrival=True)
    got = df.orderBy("arrival").collect()
    assert sorted(tuple(r)[:3] for r in got) == whole and len({r["arrival"] for r in got}) == len(got)
    in_order = [tuple(r) for name in names for r in read_csv_records(spark, name, multi_line=True).collect()]
    assert [tuple(r)[:3] for r in got] == in_order
    if size < 1000:
        assert df.rdd.getNumPartitions() > 3


def test_one_large_file_gives_several_tasks(spark, folder, small_splits):
    small_splits(20_000)
    text = "gpu_id,note\n" + "".join(f'gpu-{i},"line {i}\nnext ""{i}"""\n' for i in range(5000))
    df = read_csv_records(spark, write(folder, text), arrival=True)
    rows_ = df.orderBy("arrival").collect()
    assert [r["gpu_id"] for r in rows_] == [f"gpu-{i}" for i in range(5000)] and rows_[77]["note"] == 'line 77\nnext "77"'
    assert df.select("gpu_id").rdd.getNumPartitions() >= 5


@pytest.mark.parametrize("batch", [1, 2, 3])
def test_records_cross_batches(spark, folder, small_splits, batch):
    path = write(folder, "".join(ODD))
    whole = [tuple(r) for r in read_csv_records(spark, path, multi_line=True).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for size in (50, 1 << 20):
            small_splits(size)
            got = read_csv_records(spark, path, arrival=True).orderBy("arrival").collect()
            assert [tuple(r)[:3] for r in got] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_quote_left_open_ends_with_its_file(spark, folder):
    write(folder, 'a,b\n1,"open\nto the end', "1.csv")
    write(folder, "a,b\n2,x\n", "2.csv")
    assert sorted(map(tuple, read_csv_records(spark, folder).collect())) == [("1", "open\nto the end"), ("2", "x")]


def test_bare_quotes_open_no_cell(spark, folder, small_splits):
    path = write(folder, 'a,b\n5" disk,1\nx"y"z,"2\n3"\n"p"q,4\n6,7"\n')
    want = [('5" disk', "1"), ('x"y"z', "2\n3"), ('"p"q', "4"), ("6", '7"')]
    for size in (5, 1 << 20):
        small_splits(size)
        assert [tuple(r)[:2] for r in read_csv_records(spark, path, arrival=True).orderBy("arrival").collect()] == want
