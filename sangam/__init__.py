"""sangam: report-fusion analytics and data preparation as Spark DataFrame operators."""
