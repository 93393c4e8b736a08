"""Print the formatted physical plans of the hot paths on a given scale
factor: the kernel of one factor step, the slice histogram, the bucket map
and the core contraction.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tridelta.operators import kernel as ke  # noqa: E402
from tridelta.operators import partition as po  # noqa: E402
from tridelta.operators import tensor as te  # noqa: E402
from tridelta.plans.job import start_model  # noqa: E402
from tridelta.session import local_session, stash  # noqa: E402
from tridelta.sources.tables import default_pre_dims, sales_tensor  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    cells = sales_tensor(spark, sf)
    st = te.tensor_stats(cells)
    pre = default_pre_dims(st.dims)
    lab = stash(te.cut_regions(cells, pre), "explain-cells", partition_by=["region"])
    blocks, _, _ = start_model(spark, pre, (3, 3, 3))
    hist = te.slice_nnz(lab)
    plans = {
        "kernel (mode 0, region 100)": ke.ttm_chain(lab.where("region = '100'"), 0, blocks[1], 3, pre[1],
                                                    blocks[2], 3, pre[2]),
        "slice histogram (12 groups)": hist,
        "bucket map": po.bucket_map(hist, 12, max(st.dims)),
    }
    for name, df in plans.items():
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
