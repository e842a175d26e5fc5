"""What is kept between queries."""

import shutil
from pathlib import Path

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandline.plans.catalogue import Panel
from strandline.store import forget, stored
from tests.conftest import SF


def _copy(folder):
    folder.mkdir()
    for table in ("lineitem", "part", "supplier"):
        shutil.copyfile(f"{SF}/{table}.parquet", folder / f"{table}.parquet")
    return str(folder)


def test_panel_is_made_anew_when_its_files_change_or_are_gone(spark, tmp_path):
    sf = _copy(tmp_path / "a")
    first = Panel.of(spark, sf)
    children = first.subs.count()
    assert Panel.of(spark, sf) is first
    rows = pq.read_table(f"{SF}/lineitem.parquet")
    pq.write_table(rows.filter(pc.equal(pc.bit_wise_and(rows["l_suppkey"], 1), 0)), tmp_path / "a" / "lineitem.parquet")
    second = Panel.of(spark, sf)
    assert second is not first and 0 < second.subs.count() < children
    forget(second.subs)
    third = Panel.of(spark, sf)
    assert third is not second and third.subs.count() == second.kids.count()


def test_old_panels_are_forgotten(spark, tmp_path):
    made = [Panel.of(spark, _copy(tmp_path / str(k))) for k in range(Panel.KEPT + 1)]
    made[-1].kids.count()
    keys = {k[1] for k in Panel._made if k[0] == spark.sparkContext.applicationId}
    assert len(keys) <= Panel.KEPT and str(tmp_path / "0") not in keys and str(tmp_path / str(Panel.KEPT)) in keys


def test_stored_tables_can_be_forgotten(spark):
    table = stored(spark.range(10).withColumn("x", F.lit(1)))
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 10 and folder.is_dir()
    forget(table)
    assert not folder.exists()
