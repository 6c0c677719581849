"""Variables, bandwidths and the plans of kernel sums."""
