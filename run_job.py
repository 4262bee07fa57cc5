"""spark-submit launcher for carepulse.jobs (ship the package with --py-files):

    zip -r carepulse.zip carepulse
    spark-submit --py-files carepulse.zip run_job.py import --csv ... --table ...
"""

from carepulse.jobs import main

if __name__ == "__main__":
    main()
