"""Nothing streams: the workload is bounded tables and an epoch loop, so this package stays empty."""
