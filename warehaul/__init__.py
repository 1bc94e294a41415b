"""warehaul: the data work of moving a warehouse to Spark, as DataFrame operators."""
