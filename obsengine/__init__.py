"""obsengine: DataFrame operators for irregular multichannel sensor streams, built on Spark SQL."""
