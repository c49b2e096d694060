"""Operators that prepare large text corpora for language-model training."""

import pyarrow as pa

# Python workers live on between tasks: large buffers go back to the system as they are freed
pa.set_memory_pool(pa.system_memory_pool())
