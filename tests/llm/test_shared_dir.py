from types import SimpleNamespace

import pytest

from tideframe.llm.common import shared_dir


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_cluster_needs_a_shared_folder(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(master=master, getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))
