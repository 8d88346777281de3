"""Files behind HTTP addresses: read only, fetched whole into a folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def fetch(spark: SparkSession, url: str | list[str], folder: str) -> list[str]:
    """Copies each address into the folder (of any of Spark's file systems) and returns the paths; the JVM streams, nothing is held in memory. A status other than success raises."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for i, address in enumerate([url] if isinstance(url, str) else url):
        if not address.startswith(("http://", "https://")):
            raise ValueError(f"no HTTP address: {address!r}")
        name = address.split("?")[0].split("#")[0].rstrip("/").rpartition("/")[2] or "index"
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{i:05d}-{name}")
        source = jvm.java.net.URI(address).toURL().openStream()
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, path.getFileSystem(conf).create(path, True), 1 << 16, True)
        out.append(path.toString())
    return out
