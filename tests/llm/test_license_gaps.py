"""Long gaps and long expressions in license scans."""
import pytest

from corpusloom.llm import licenses

GAP = "\n" + " " * 39
PROBES = [
    (f"GNU Affero General{GAP}Public License version 3", "agpl-3"), (f"Creative{GAP}Commons{GAP}Attribution{GAP}4.0", "cc-by-4.0"), (f"Apache License,{GAP}Version{GAP}2.0", "apache-2.0"),
    ("SPDX-License-Identifier:\t" + " OR ".join(["MIT"] * 13 + ["ISC"]), "isc"), ("SPDX-License-Identifier: (MIT\tOR\t Zlib )", "zlib"), ("SPDX-License-Identifier: " + " AND ".join(["MIT"] * 600 + ["0BSD"]), "0bsd"),
]


@pytest.mark.parametrize("text, label", PROBES)
def test_long_gaps(spark, text, label):
    r = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in r.labels.split(","), r.labels


def test_runs_of_other_characters_stay_linear(spark):
    text = ("GNU General Public License" + "-" * 60_000 + " v ") * 3 + "Creative Commons" + "\n" * 60_000
    assert licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_base == 3
