"""The assembler and its parts: configuration, kernels, clipping, filters, statistics, comparison."""
