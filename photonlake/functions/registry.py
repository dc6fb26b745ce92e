"""Names of tags, datasets and namespaces, and the dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the GPS standard: tag, name and type, in order of tags.
GPS_TAGS = (
    (0x0000, "GPSVersionID", "Byte"),
    (0x0001, "GPSLatitudeRef", "ASCII"),
    (0x0002, "GPSLatitude", "Rational"),
    (0x0003, "GPSLongitudeRef", "ASCII"),
    (0x0004, "GPSLongitude", "Rational"),
    (0x0005, "GPSAltitudeRef", "Byte"),
    (0x0006, "GPSAltitude", "Rational"),
    (0x0007, "GPSTimeStamp", "Rational"),
    (0x0008, "GPSSatellites", "ASCII"),
    (0x0009, "GPSStatus", "ASCII"),
    (0x000A, "GPSMeasureMode", "ASCII"),
    (0x000B, "GPSDOP", "Rational"),
    (0x000C, "GPSSpeedRef", "ASCII"),
    (0x000D, "GPSSpeed", "Rational"),
    (0x000E, "GPSTrackRef", "ASCII"),
    (0x000F, "GPSTrack", "Rational"),
    (0x0010, "GPSImgDirectionRef", "ASCII"),
    (0x0011, "GPSImgDirection", "Rational"),
    (0x0012, "GPSMapDatum", "ASCII"),
    (0x0013, "GPSDestLatitudeRef", "ASCII"),
    (0x0014, "GPSDestLatitude", "Rational"),
    (0x0015, "GPSDestLongitudeRef", "ASCII"),
    (0x0016, "GPSDestLongitude", "Rational"),
    (0x0017, "GPSDestBearingRef", "ASCII"),
    (0x0018, "GPSDestBearing", "Rational"),
    (0x0019, "GPSDestDistanceRef", "ASCII"),
    (0x001A, "GPSDestDistance", "Rational"),
    (0x001B, "GPSProcessingMethod", "Undefined"),
    (0x001C, "GPSAreaInformation", "Undefined"),
    (0x001D, "GPSDateStamp", "ASCII"),
    (0x001E, "GPSDifferential", "Short"),
    (0x001F, "GPSHPositioningError", "Rational"),
)
#: Fixed values of the TIFF and EXIF standards: tag, name and type, in order of tags.
EXIF_TAGS = (
    (0x00FE, "NewSubfileType", "Long"),
    (0x00FF, "SubfileType", "Short"),
    (0x0100, "ImageWidth", "Short"),
    (0x0101, "ImageLength", "Short"),
    (0x0102, "BitsPerSample", "Short"),
    (0x0103, "Compression", "Short"),
    (0x0106, "PhotometricInterpretation", "Short"),
    (0x0107, "Thresholding", "Short"),
    (0x010A, "FillOrder", "Short"),
    (0x010D, "DocumentName", "ASCII"),
    (0x010E, "ImageDescription", "ASCII"),
    (0x010F, "Make", "ASCII"),
    (0x0110, "Model", "ASCII"),
    (0x0111, "StripOffsets", "Long"),
    (0x0112, "Orientation", "Short"),
    (0x0115, "SamplesPerPixel", "Short"),
    (0x0116, "RowsPerStrip", "Long"),
    (0x0117, "StripByteCounts", "Long"),
    (0x0118, "MinSampleValue", "Short"),
    (0x0119, "MaxSampleValue", "Short"),
    (0x011A, "XResolution", "Rational"),
    (0x011B, "YResolution", "Rational"),
    (0x011C, "PlanarConfiguration", "Short"),
    (0x011D, "PageName", "ASCII"),
    (0x011E, "XPosition", "Rational"),
    (0x011F, "YPosition", "Rational"),
    (0x0122, "GrayResponseUnit", "Short"),
    (0x0123, "GrayResponseCurve", "Short"),
    (0x0128, "ResolutionUnit", "Short"),
    (0x0129, "PageNumber", "Short"),
    (0x012D, "TransferFunction", "Short"),
    (0x0131, "Software", "ASCII"),
    (0x0132, "DateTime", "ASCII"),
    (0x013B, "Artist", "ASCII"),
    (0x013C, "HostComputer", "ASCII"),
    (0x013D, "Predictor", "Short"),
    (0x013E, "WhitePoint", "Rational"),
    (0x013F, "PrimaryChromaticities", "Rational"),
    (0x0140, "ColorMap", "Short"),
    (0x0141, "HalftoneHints", "Short"),
    (0x0142, "TileWidth", "Long"),
    (0x0143, "TileLength", "Long"),
    (0x0144, "TileOffsets", "Long"),
    (0x0145, "TileByteCounts", "Long"),
    (0x014A, "SubIFDs", "Long"),
    (0x0152, "ExtraSamples", "Short"),
    (0x0153, "SampleFormat", "Short"),
    (0x0201, "JPEGInterchangeFormat", "Long"),
    (0x0202, "JPEGInterchangeFormatLength", "Long"),
    (0x0211, "YCbCrCoefficients", "Rational"),
    (0x0212, "YCbCrSubSampling", "Short"),
    (0x0213, "YCbCrPositioning", "Short"),
    (0x0214, "ReferenceBlackWhite", "Rational"),
    (0x02BC, "XMP", "Byte"),
    (0x8298, "Copyright", "ASCII"),
    (0x829A, "ExposureTime", "Rational"),
    (0x829D, "FNumber", "Rational"),
    (0x8769, "ExifIFDPointer", "Long"),
    (0x8801, "StandardOutputSensitivity", "Long"),
    (0x8822, "ExposureProgram", "Short"),
    (0x8825, "GPSIFDPointer", "Long"),
    (0x8827, "ISOSpeedRatings", "Short"),
    (0x8830, "SensitivityType", "Short"),
    (0x8832, "RecommendedExposureIndex", "Long"),
    (0x9003, "DateTimeOriginal", "ASCII"),
    (0x9004, "DateTimeDigitized", "ASCII"),
    (0x9010, "OffsetTime", "ASCII"),
    (0x9011, "OffsetTimeOriginal", "ASCII"),
    (0x9012, "OffsetTimeDigitized", "ASCII"),
    (0x9201, "ShutterSpeedValue", "SRational"),
    (0x9202, "ApertureValue", "Rational"),
    (0x9203, "BrightnessValue", "SRational"),
    (0x9204, "ExposureBiasValue", "SRational"),
    (0x9205, "MaxApertureValue", "Rational"),
    (0x9206, "SubjectDistance", "Rational"),
    (0x9207, "MeteringMode", "Short"),
    (0x9208, "LightSource", "Short"),
    (0x9209, "Flash", "Short"),
    (0x920A, "FocalLength", "Rational"),
    (0x927C, "MakerNote", "Undefined"),
    (0x9290, "SubSecTime", "ASCII"),
    (0x9291, "SubSecTimeOriginal", "ASCII"),
    (0x9292, "SubSecTimeDigitized", "ASCII"),
    (0xA000, "FlashpixVersion", "Undefined"),
    (0xA001, "ColorSpace", "Short"),
    (0xA002, "PixelXDimension", "Long"),
    (0xA003, "PixelYDimension", "Long"),
    (0xA004, "RelatedSoundFile", "ASCII"),
    (0xA005, "InteroperabilityIFDPointer", "Long"),
    (0xA20E, "FocalPlaneXResolution", "Rational"),
    (0xA20F, "FocalPlaneYResolution", "Rational"),
    (0xA210, "FocalPlaneResolutionUnit", "Short"),
    (0xA215, "ExposureIndex", "Rational"),
    (0xA217, "SensingMethod", "Short"),
    (0xA401, "CustomRendered", "Short"),
    (0xA402, "ExposureMode", "Short"),
    (0xA403, "WhiteBalance", "Short"),
    (0xA404, "DigitalZoomRatio", "Rational"),
    (0xA405, "FocalLengthIn35mmFilm", "Short"),
    (0xA406, "SceneCaptureType", "Short"),
    (0xA407, "GainControl", "Rational"),
    (0xA408, "Contrast", "Short"),
    (0xA409, "Saturation", "Short"),
    (0xA40A, "Sharpness", "Short"),
    (0xA40B, "DeviceSettingDescription", "Undefined"),
    (0xA40C, "SubjectDistanceRange", "Short"),
    (0xA420, "ImageUniqueID", "ASCII"),
    (0xA430, "CameraOwnerName", "ASCII"),
    (0xA431, "BodySerialNumber", "ASCII"),
    (0xA432, "LensSpecification", "Rational"),
    (0xA433, "LensMake", "ASCII"),
    (0xA434, "LensModel", "ASCII"),
    (0xA435, "LensSerialNumber", "ASCII"),
)
#: Fixed values of the IPTC-IIM standard: record, dataset and name, in order of both.
DATASETS = (
    (1, 90, "CodedCharacterSet"),
    (2, 3, "ObjectTypeReference"),
    (2, 4, "ObjectAttributeReference"),
    (2, 5, "ObjectName"),
    (2, 7, "EditStatus"),
    (2, 10, "Urgency"),
    (2, 12, "SubjectReference"),
    (2, 15, "Category"),
    (2, 20, "SupplementalCategory"),
    (2, 25, "Keywords"),
    (2, 40, "SpecialInstructions"),
    (2, 55, "DateCreated"),
    (2, 60, "TimeCreated"),
    (2, 62, "DigitalCreationDate"),
    (2, 63, "DigitalCreationTime"),
    (2, 65, "OriginatingProgram"),
    (2, 70, "ProgramVersion"),
    (2, 80, "Byline"),
    (2, 85, "BylineTitle"),
    (2, 90, "City"),
    (2, 92, "SubLocation"),
    (2, 95, "ProvinceState"),
    (2, 100, "CountryCode"),
    (2, 101, "CountryName"),
    (2, 103, "OriginalTransmissionReference"),
    (2, 105, "Headline"),
    (2, 110, "Credit"),
    (2, 115, "Source"),
    (2, 116, "CopyrightNotice"),
    (2, 118, "Contact"),
    (2, 120, "Caption"),
    (2, 122, "CaptionWriter"),
    (2, 130, "ImageType"),
    (2, 131, "ImageOrientation"),
    (2, 135, "LanguageIdentifier"),
)
#: Prefixes and URIs of XMP namespaces.
NAMESPACES = {
    "xmp": "http://ns.adobe.com/xap/1.0/", "xmpRights": "http://ns.adobe.com/xap/1.0/rights/", "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
    "dc": "http://purl.org/dc/elements/1.1/", "photoshop": "http://ns.adobe.com/photoshop/1.0/", "exif": "http://ns.adobe.com/exif/1.0/",
    "tiff": "http://ns.adobe.com/tiff/1.0/", "aux": "http://ns.adobe.com/exif/1.0/aux/", "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "x": "adobe:ns:meta/",
    "cc": "http://creativecommons.org/ns#", "pdf": "http://ns.adobe.com/pdf/1.3/", "xmpNote": "http://ns.adobe.com/xap/1.0/se/Note/",
}
#: The formats that are read and written.
FORMATS = ("JPEG", "TIFF", "PNG", "HEIF", "AVIF", "WebP", "CR2", "CR3", "NEF", "ARW", "DNG", "ORF", "RW2")
#: What the EXIF standard calls some numbers.
ENUMS = {
    "orientation": {1: "Horizontal", 2: "Mirror horizontal", 3: "Rotate 180", 4: "Mirror vertical", 5: "Mirror horizontal and rotate 270 CW", 6: "Rotate 90 CW", 7: "Mirror horizontal and rotate 90 CW", 8: "Rotate 270 CW"},
    "exposure_mode": {0: "Auto", 1: "Manual", 2: "Auto bracket"},
    "white_balance": {0: "Auto", 1: "Manual"},
    "metering_mode": {0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial", 255: "Other"},
    "color_space": {1: "sRGB", 65535: "Uncalibrated"},
}


def tags(spark: SparkSession) -> DataFrame:
    """family (gps or exif), tag, name, type: GPS tags share small numbers with no other family here."""
    rows = [("gps", *t) for t in GPS_TAGS] + [("exif", *t) for t in EXIF_TAGS]
    return spark.createDataFrame(rows, "family string, tag int, name string, type string")


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DATASETS), "record int, dataset int, name string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x, True) for i, x in enumerate(FORMATS, 1)], "id int, name string, writable boolean")
