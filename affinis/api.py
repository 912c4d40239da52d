"""The public functions and classes in one place."""

from affinis.config import Delimited, Execution, Files, Limits, Table, Workbook
from affinis.functions.codecs import Bzip2, Gzip, Lzma, Ppmd, Zlib
from affinis.functions.codecs import fingerprint as codec_fingerprint
from affinis.operators.community import cluster as cluster_tree
from affinis.operators.distance import MatrixView, distances
from affinis.operators.objects import by_columns, by_rows, from_dataset, from_files
from affinis.operators.tree import Tree, neighbor_joining, newick
from affinis.plans.estimate import Estimate
from affinis.plans.partition import PartitionResult, partition_dataset, partition_rows
from affinis.plans.run import Report, Result, estimate, load_result, run

__all__ = [
    "Bzip2", "Delimited", "Estimate", "Execution", "Files", "Gzip", "Limits", "Lzma", "MatrixView", "PartitionResult", "Ppmd", "Report", "Result", "Table", "Tree",
    "Workbook", "Zlib", "by_columns", "by_rows", "cluster_tree", "codec_fingerprint", "distances", "estimate", "from_dataset", "from_files", "load_result", "neighbor_joining", "newick",
    "partition_dataset", "partition_rows", "run",
]
