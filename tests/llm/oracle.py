"""Run queries of the subpackage against their SQL: python tests/llm/oracle.py SF_DIR NAME..."""

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.dirname(HERE)]

if __name__ == "__main__":
    from oracle_check import compare, duck
    from pulsepanel import get_spark
    from pulsepanel.llm.queries import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or sorted(ORACLES)
    spark = get_spark()
    for name in names:
        print(name, *compare(spark, name, QUERIES[name], ORACLES[name], sf_dir, duck(sf_dir)))
