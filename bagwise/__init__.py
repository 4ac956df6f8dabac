"""bagwise: data work of a bagged text-classification ensemble as Spark jobs.

Every public function maps DataFrame(s) to DataFrame(s); draws are defined by
a portable md5 hash so that results can be reproduced by an SQL oracle.
"""

__version__ = "0.1.0"
