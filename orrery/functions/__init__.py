"""Column functions: dense, sparse and curved vectors, quantization, distributions, text and geography."""
