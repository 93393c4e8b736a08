"""Two increments of the sales tensor arrive as files of a stream."""

from conftest import SF0001
from tridelta.operators.tensor import tensor_stats
from tridelta.session import scratch_path
from tridelta.sources.tables import sales_tensor
from tridelta.streaming.micro_batch import latest_model, start_stream


def test_stream_updates_model_per_batch(spark):
    cells = sales_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    start = tuple(d * 3 // 5 for d in dims)
    mid = tuple(d * 4 // 5 for d in dims)
    src = scratch_path(spark, "stream-src")
    first = cells.where(f"i <= {mid[0]} AND j <= {mid[1]} AND k <= {mid[2]}")
    first.write.parquet(f"{src}/b0")
    model_dir, ckpt = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-ckpt")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = start_stream(stream, model_dir, ckpt, start, ranks=(2, 2, 2))
    q.awaitTermination(600)
    _, core1, dims1, v1 = latest_model(spark, model_dir)
    assert dims1 == tuple(max(a, b) for a, b in zip(start, tensor_stats(first).dims))
    cells.write.parquet(f"{src}/b1")
    q = start_stream(spark.readStream.schema(first.schema).parquet(f"{src}/*"), model_dir, ckpt, start, ranks=(2, 2, 2))
    q.awaitTermination(600)
    factors, core2, dims2, v2 = latest_model(spark, model_dir)
    assert v2 > v1 and dims2 == dims
    assert core2.count() == 8
    assert 0 < factors.count() <= sum(dims)


def test_a_repeated_batch_counts_once(spark):
    from tridelta.streaming.micro_batch import _versions, batch_updater
    from tridelta.session import delete_paths

    cells = sales_tensor(spark, SF0001)
    dims = tensor_stats(cells).dims
    start = tuple(d * 4 // 5 for d in dims)
    model_dir = scratch_path(spark, "stream-model")
    run = batch_updater(model_dir, start, ranks=(2, 2, 2))
    run(cells, 0)
    first = sorted(map(tuple, latest_model(spark, model_dir)[0].collect()))
    run(cells, 0)  # delivered again after it was finished
    assert sorted(map(tuple, latest_model(spark, model_dir)[0].collect())) == first and _versions(spark, model_dir) == [0]
    bigger = cells.selectExpr("i + 7 AS i", "j + 3 AS j", "k + 2 AS k", "val")
    run(bigger, 1)
    second = sorted(map(tuple, latest_model(spark, model_dir)[0].collect()))
    delete_paths(spark, [f"{model_dir}/v=1/manifest-000000000.json"])  # stopped between write and commit
    assert latest_model(spark, model_dir)[3] == 0
    run(bigger, 1)
    again = sorted(map(tuple, latest_model(spark, model_dir)[0].collect()))
    assert len(again) == len(second)
    assert all(abs(x - y) < 1e-9 for a, b in zip(again, second) for x, y in zip(a, b))
    assert _versions(spark, model_dir) == [0, 1]
